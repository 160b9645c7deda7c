"""Operators on change records (key, value, op): the last record of each key, compaction, and rollover by size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = 0, 1
#: Bytes of an entry beside its key and value: key length 2, value length 4, operation 1.
ENTRY = 7


def latest(log: DataFrame, order: Column | str, key: str = "key", value: str = "value", op: str = "op") -> DataFrame:
    """One row per key, its last record by order, deletes included. Partial aggregation keeps hot keys cheap."""
    last = log.groupBy(key).agg(F.max_by(F.struct(value, op), order).alias("x"))
    return last.select(key, f"x.{value}", f"x.{op}")


def live(log: DataFrame, order: Column | str, **names: str) -> DataFrame:
    out = latest(log, order, **names)
    return out.where(F.col(names.get("op", "op")) == PUT)


def compact(runs: DataFrame, bottom: bool, file_id: str = "file_id") -> DataFrame:
    """Merge sorted runs: the newest file's record of each key; deletes go only at the bottom level."""
    out = latest(runs, F.col(file_id))
    return out.where(F.col("op") == PUT) if bottom else out


def entry_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY


def rollover(sorted_ranges: DataFrame, limit: int) -> DataFrame:
    """Rows of sorted partitions with the file each goes to: a file is closed once its entries have limit bytes or more.

    A partition's rows are read in order and never held; each partition begins a file of its own.
    """
    names = ["key", "value", "op"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            lengths = [pc.fill_null(pc.binary_length(b.column(b.schema.names.index(c))), 0).to_numpy(zero_copy_only=False) for c in ("key", "value")]
            ends = np.cumsum(lengths[0].astype(np.int64) + lengths[1] + ENTRY)
            files, at, before = np.empty(len(ends), np.int64), 0, 0
            while at < len(ends):
                cut = int(np.searchsorted(ends, before + limit - size)) + 1  # the entry that fills the file is its last
                files[at:cut] = n
                if cut > len(ends):
                    size += int(ends[-1]) - before
                    break
                before, at, size, n = int(ends[cut - 1]), cut, 0, n + 1
            label = pa.array([f"{part:06d}-{k:06d}" for k in files], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in names], label], names=[*names, "file"])

    return sorted_ranges.select(*names).mapInArrow(run, "key binary, value binary, op tinyint, file string")
