"""Operators on keyed records: latest-wins merge, compaction, rollover by size, Bloom filters."""
