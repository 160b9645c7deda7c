"""SimHash near-dedup: segment-popcount embedding, grid range join, exact check.

Candidate search: fingerprints that differ in at most BITS = 4 bits differ in at most 2 in one of their halves. A
half is embedded as the bit counts of its 16 segments of 2 bits; the Manhattan distance of these vectors is a lower
bound of the Hamming distance. A fingerprint is put into the grid cells (points) within distance 1 of its own vector;
vectors within distance 2 share a point, so no link is lost. Equal fingerprints are one.

In a cell, links are checked on the bits. Groups of up to SMALL emit their links; larger ones emit a spanning forest,
found by breadth-first search in which a reached fingerprint is not compared again, so that dense groups cost little
and no group emits all pairs. Cells hold different fingerprints only, so a cell doesn't grow with copies.

The pipeline's stage links at up to STAGE_BITS bits, among fingerprints that share a point. So beyond 4 bits, those
link whose vectors are within distance 2 in a half; larger cells emit the forest at 4 bits and that at STAGE_BITS. What
these links leave out of the pairs that are similar enough, an exact search between the groups so found adds (`missing`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, small_batches, small_side
from .components import components

SHINGLE, SEED, BITS, SMALL = 4, 42, 4, 32
#: The pipeline's stage takes five-word shingles and several fingerprints of each document: each finds a part of the
#: copies whose shingles are 0.8 similar or more, so together they find more. At a similarity of 0.8 about 10 of 64 bits
#: differ; of unrelated fingerprints, one pair in 10^8 differs in so few.
STAGE_SHINGLE, STAGE_WORDS, STAGE_LEAST, STAGE_BITS = 5, 6, 0.8, 10
#: Rows of sorted cells that are worked on together, about.
GATHER = 100_000
#: Groups that cells are counted by, for each million fingerprints; rows of a group, over the mean, that are split.
COARSE, HEAVY = 65_536, 50_000
#: Rounds in which links of fingerprints are compared; the exact search finds what they leave.
ROUNDS = 5
#: Documents that frequent shingles are counted in, at least (or one in a hundred); frequent shingles that are kept.
SAMPLE, COMMON = 20_000, 1 << 17


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each shingle, repeats included; of fewer words than `size`, that of them all; none without words."""
    split = text.lower().split()  # bytes: ASCII white space and letters only
    if not split:
        return []
    joined = b" ".join(split)
    if len(split) < size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(text: bytes, size: int = SHINGLE, words: int = 1) -> list[int]:
    """`words` fingerprints as signed 64-bit numbers; a bit is 1 if set in over half the shingle hashes; no words: zero.

    The first is of the shingles' XXH64, each other one of these hashes mixed anew, so all are of the same shingles.
    """
    hashes = shingle_hashes(text, size)
    if not hashes:
        return [0] * words
    counts = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), 1 << 13):
        part = np.array(hashes[i : i + (1 << 13)], dtype=np.uint64)
        for k in range(words):
            mixed = _mixed(part, k) if k else part
            counts[k] += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), axis=1).view(">i8")[:, 0].tolist()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of bijective mixings of 64-bit numbers."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, th (hash of the text), fp and more (the other fingerprints) of every document row; null texts have no words."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), size, words) for t in b.column(2)]
            cols = [pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1:] for f in fps], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "th", "fp", "more"])

    return source.mapInArrow(run, "doc_id long, th long, fp long, more array<long>")


def cells(fps: np.ndarray, word: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of each fingerprint, apart for each of a document's fingerprints: (cell, fingerprint) arrays."""
    word = np.broadcast_to(np.asarray(word, np.uint64), fps.shape)
    u = fps.view(np.uint64)
    out_c, out_f = [], []
    for half in (0, 1):
        bits = (u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        count = (bits & np.uint64(0x55555555)) + ((bits >> np.uint64(1)) & np.uint64(0x55555555))  # 16 counts, 2 bits each
        tag = np.uint64(half << 32) + (word << np.uint64(33))
        out_c.append(count | tag)
        out_f.append(fps)
        for j in range(16):
            one = np.uint64(1 << (2 * j))
            value = (count >> np.uint64(2 * j)) & np.uint64(3)
            for ok, moved in ((value < 2, count + one), (value > 0, count - one)):
                out_c.append(moved[ok] | tag[ok])
                out_f.append(fps[ok])
    return np.concatenate(out_c).view(np.int64), np.concatenate(out_f)


def _forest(f: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    links, rest = [], f
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = np.bitwise_count(rest.view(np.uint64) ^ np.int64(x).view(np.uint64)) <= bits
            if hit.any():
                links += [(int(x), int(y)) for y in rest[hit]]
                todo.extend(rest[hit])
                rest = rest[~hit]
    return links


def links_in_cells(cell: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links (a, b) within equal cells of sorted input, and a place in the cell of each."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(edge)
    small = np.repeat(sizes <= SMALL, sizes)
    a, b, at = [], [], []
    for lag in range(1, int(min(sizes.max(initial=0), SMALL))):
        same = (cell[lag:] == cell[:-lag]) & small[lag:]
        i = np.flatnonzero(same)
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + lag].view(np.uint64)) <= bits]
        a.append(fp[i])
        b.append(fp[i + lag])
        at.append(i)
    for s, n in zip(edge[:-1], sizes):
        if n > SMALL and (big := [x for k in sorted({BITS, bits}) for x in _forest(fp[s : s + n], k)]):
            x = np.array(big, dtype=np.int64)
            a.append(x[:, 0])
            b.append(x[:, 1])
            at.append(np.full(len(x), s))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([none, *at])


def fingerprint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, a, b): links between different fingerprints of one word, enough for the components; fps (a written table) has distinct word, fp.

    Cells are counted first, by hash in groups whose mean size doesn't grow with the corpus. The fingerprints of groups
    that hold far more than that are dealt to blocks by salt, and each block meets each other one in a task of its own;
    so no task holds more of a cell than about two blocks, and all pairs still meet.
    """
    fps = fps.select("word", "fp")
    n = fps.count()
    buckets = np.uint64(COARSE * (1 + n // 1_000_000))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                word, fp = (c.slice(i, 4096).to_numpy(zero_copy_only=False) for c in b.columns)
                c, f = cells(fp.astype(np.int64), word.astype(np.uint64))
                yield c, f, (_mixed(c.view(np.uint64), 1) % buckets).view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def done() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["coarse", "n"])

        for _, _, coarse in points(batches):
            waiting.append(coarse)
            size += len(coarse)
            if size > 1 << 22:
                yield done()
                waiting, size = [], 0
        if waiting:
            yield done()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, f, coarse in points(batches):
            word = (c.view(np.uint64) >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(word), pa.array(f), pa.array(coarse)], names=["cell", "word", "fp", "coarse"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, ...]] = [(none, none.astype(np.int32), none)]
        waiting, enough = 0, GATHER

        def done(cell, word, f):
            a, b, at = links_in_cells(2 * np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]) | (word[1:] != word[:-1])])), f, bits)
            return pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(a), pa.array(b)], names=["word", "a", "b"])

        for b in batches:  # sorted by cell; the last cell waits for its rest
            parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            waiting += b.num_rows
            if waiting < enough:
                continue
            cell, word, fp = (np.concatenate(x) for x in zip(*parts))
            cut = int(np.searchsorted(cell, cell[-1], "left"))
            if cut:
                yield done(cell[:cut], word[:cut], fp[:cut])
            parts, waiting = [(cell[cut:], word[cut:], fp[cut:])], len(cell) - cut
            enough = max(GATHER, 2 * waiting)  # so that a large cell is put together few times
        if waiting:
            yield done(*(np.concatenate(x) for x in zip(*parts)))

    mean = 66 * n // int(buckets)
    sizes = fps.mapInArrow(count, "coarse long, n long").groupBy("coarse").agg(F.sum("n").alias("n"))
    heavy = materialize(sizes.where(F.col("n") > HEAVY + 4 * mean).select("coarse", F.ceil(2 * F.col("n") / HEAVY).cast("int").alias("blocks")), "heavy-cells")
    placed = fps.mapInArrow(spread, "cell long, word int, fp long, coarse long")
    if heavy.isEmpty():
        placed = placed.select("cell", "word", "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("cell", F.least(k, mine), F.greatest(k, mine)))
        met = F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(met)
        placed = placed.join(small_side(heavy), "coarse", "left").select(F.explode(met).alias("cell"), "word", "fp")
    return placed.repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(check, "word int, a long, b long").distinct()


def _different(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts (fp, text): fp, shingles (the different hashes, as the fingerprints take them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_different(t.as_py(), size).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    return texts.mapInArrow(run, "fp long, shingles array<long>")


def similar(docs: DataFrame, links: DataFrame, firsts: DataFrame, size: int, least: float, most: int | None = None) -> DataFrame:
    """Links (a, b) of which the first documents of both ends have a Jaccard similarity of shingles of `least` or more: enough for the components.

    links (a written table): a, b and la, lb, the groups that the ends are in so far. Many links are compared in rounds:
    each end takes some of its links, and links within a group that the rounds before made are not compared. So a round
    moves about as many bytes of sets as the ends' own, or half the texts', however many links a dense group has. With
    `most`, links are left over after so many rounds.
    """
    ends = materialize(links.select("a").unionAll(links.select("b")).toDF("fp").distinct().join(firsts, "fp").select("fp", F.col("first.doc_id").alias("d"), F.col("first.th").alias("h")), "link-ends")
    texts = docs.select("doc_id", "text").join(small_side(ends), docs["doc_id"].eqNullSafe(ends["d"]) & (F.xxhash64(docs["text"]) == ends["h"]))
    sets = materialize(shingle_sets(texts.select("fp", F.coalesce("text", F.lit("")).cast("binary").alias("text")), size).dropDuplicates(["fp"]), "shingle-sets")
    n, held = sets.agg(F.count("*"), F.sum(8 * F.size("shingles").cast("long"))).first()
    room = max(n, (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) * n // (2 * (held or 1)))  # links of a round
    left, found, step = links, [], 0
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = shared >= least * (F.size("of_a") + F.size("of_b") - shared)
    while (count := left.count()) and (most is None or step < most):
        step += 1
        taken = left
        if count > room:
            both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lb").alias("la"), F.col("la").alias("lb")))
            slots = max(1, room // both.select("a").distinct().count())
            pick = F.min_by(F.struct("b", "la", "lb"), F.xxhash64("a", "b", F.lit(step)))
            taken = materialize(both.groupBy("a", F.pmod(F.xxhash64("a", "b"), F.lit(slots)).alias("slot")).agg(pick.alias("x")).select("a", "x.b", "x.la", "x.lb"), "taken-links")
        pairs = taken.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
        good = materialize(pairs.where(alike).select("a", "b", "la", "lb"), "similar-links")
        found.append(good)
        if taken is left:
            break
        label = components(good.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        done = taken.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
        rest = left.join(done, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
        for end in ("la", "lb"):
            rest = rest.join(small_side(label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_new"))), end, "left").withColumn(end, F.coalesce(f"{end}_new", end))
        rest = materialize(rest.where("la <> lb").select("a", "b", "la", "lb"), "links-left")
        discard(label, taken, *([] if left is links else [left]))
        left = rest
    every = found[0] if found else links.limit(0)
    for more in found[1:]:
        every = every.unionAll(more)
    out = materialize(every.select("a", "b"), "similar-links")
    discard(ends, sets, *found, *([] if left is links else [left]))
    return out


def _row() -> Column:
    """Orders the rows of documents: by id, nulls last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")


def common_shingles(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """Hashes of shingles that three or more of a sample of the n documents hold, the most frequent last."""
    one_in = max(1, n // max(SAMPLE, n // 100))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    sets = shingle_sets(sample.select(F.lit(0).cast("long").alias("fp"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), size)
    held = sets.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = held.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return top.column(0).to_numpy()[::-1].view(np.uint64)


def postings(docs: DataFrame, size: int, least: float, common: np.ndarray) -> DataFrame:
    """th, n (different shingles), shingle, place of the first shingles of every document row, in one order of all shingles: common ones last.

    Of n shingles, `least` x n or more are in any set that is so similar; so two such sets share one of the first ones,
    as many as may be missing and one more, in whichever order.
    """
    by = np.argsort(common)
    values, ranks = common[by], by + 1
    source = docs.select(F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))

    def first(text: bytes) -> tuple[int, np.ndarray]:
        s = _different(text, size)
        if len(values):
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            s = s[np.argsort(np.where(values[at] == s, ranks[at], 0), kind="stable")]
        return len(s), s[: len(s) - int(np.ceil(least * len(s) - 1e-6)) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first(t.as_py()) for t in b.column(1)]
            counts = [len(s) for _, s in found]
            th, n = np.repeat(b.column(0).to_numpy(), counts), np.repeat(np.array([n for n, _ in found], np.int32), counts)
            shingle = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in found)]).view(np.int64)
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in counts)])
            yield pa.RecordBatch.from_arrays([pa.array(th), pa.array(n), pa.array(shingle), pa.array(place)], names=["th", "n", "shingle", "place"])

    return source.mapInArrow(run, "th long, n int, shingle long, place int")


def missing(docs: DataFrame, prints: DataFrame, label: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): fingerprints of pairs of texts that are `least` similar and of different components (label: node, label), enough to join all such pairs.

    Pairs meet by a shingle among the first ones of both; they are compared unless their numbers of shingles, or the
    shingles after the shared one, are too few. The sample of frequent shingles sets the order alone, so it changes no
    result. Shingles of one text or one component are dropped before the join, so groups of copies cost little.
    """
    every = materialize(postings(docs, size, least, common_shingles(docs, prints.count(), size)), "postings")

    def met(rows: DataFrame, by: str) -> DataFrame:
        ends = rows.groupBy("shingle").agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
        return materialize(ends.where("lo <> hi").select("shingle"), "shared-shingles")

    many = met(every, "th")
    texts = prints.select("th", "fp").distinct()
    linked = materialize(texts.join(small_side(label), texts["fp"] == label["node"]).select("th", "label"), "linked-texts")
    held = every.join(small_side(many), "shingle").distinct().join(small_side(linked), "th", "left")
    held = materialize(held.select("shingle", "th", "n", "place", F.coalesce("label", "th").alias("of")), "held-postings")
    apart = met(held, "of")
    left = held.join(small_side(apart), "shingle")
    right = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("th", "n", "place", "of")])
    rest = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    near = (F.least("n", "n_b") >= least * F.greatest("n", "n_b") - 1e-6) & (rest >= least / (1 + least) * (F.col("n") + F.col("n_b")) - 1e-6)
    pairs = left.join(right, "shingle").where((F.col("of") < F.col("of_b")) & near).select(F.col("th").alias("a"), F.col("th_b").alias("b"), F.col("of").alias("la"), F.col("of_b").alias("lb")).distinct()
    pairs = materialize(pairs, "near-texts")
    discard(every, many, linked, held, apart)
    firsts = prints.groupBy("th").agg(F.min(_row()).alias("first")).withColumnRenamed("th", "fp")
    found = similar(docs, pairs, firsts, size, least)
    end = lambda side: texts.select(F.col("th").alias(side), F.col("fp").alias(f"f{side}"))
    out = materialize(small_side(found).join(end("a"), "a").join(end("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")).where("a <> b").distinct(), "missing-links")
    discard(pairs, found)
    return out


def groups(docs: DataFrame, size: int = SHINGLE, words: int = 1, least: float = 0.0, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(prints, component): doc_id, th, fp of every row; and of every fp its component_id and the component's first row (struct none, doc_id, th).

    Documents are linked if any of their `words` fingerprints differ in at most `bits` bits (beyond
    BITS: and share a grid point). A document stands under its
    first fingerprint fp: equal ones are linked anyway. Where others link, the least fp of their documents stands for them.
    With `least`, a link between different fp counts only if its shingles are so similar; the links of a cell of more
    than SMALL fingerprints are its forest's, and ROUNDS rounds of links are compared. All other pairs of texts that are
    so similar are linked as well, if these links don't join them (`missing`).
    """
    prints = materialize(fingerprints(docs, size, words), "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(_row()).alias("first")), "distinct-fingerprints")
    if words == 1:
        used = [materialize(fps.select(F.lit(0).alias("word"), "fp"), "words")]
        links = fingerprint_links(used[0], bits).select("a", "b")
    else:
        others = prints.select("fp", F.posexplode("more").alias("word", "f")).withColumn("word", F.col("word") + 1)
        stands = materialize(others.groupBy("word", "f").agg(F.min("fp").alias("rep"), F.max("fp").alias("far")), "other-fingerprints")
        every = materialize(fps.select(F.lit(0).alias("word"), "fp").unionAll(stands.select("word", F.col("f").alias("fp"))), "words")
        found = materialize(fingerprint_links(every, bits), "word-links")
        used = [stands, every, found]
        rep = lambda side: stands.select("word", F.col("f").alias(side), F.col("rep").alias(f"r{side}"))
        via = small_side(found.where("word > 0")).join(rep("a"), ["word", "a"]).join(rep("b"), ["word", "b"]).select("ra", "rb")
        shared = others.join(small_side(stands.where("rep <> far").drop("far")), ["word", "f"]).select("fp", "rep").distinct()  # one f, different fp
        links = found.where("word = 0").select("a", "b").unionAll(via.toDF("a", "b")).unionAll(shared.toDF("a", "b"))
    links = materialize(links.where("a <> b").distinct(), "fingerprint-links")
    if least:
        used.append(links)
        links = similar(docs, links.withColumns({"la": F.col("a"), "lb": F.col("b")}), fps, size, least, ROUNDS)
    label = components(links)
    if least:
        more = missing(docs, prints, label, size, least)
        used.append(more)
        if not more.isEmpty():
            used.append(links)
            links = materialize(links.unionAll(more), "all-links")
            discard(label)
            label = components(links)
    mine = label.join(fps, label["node"] == fps["fp"])
    best = mine.groupBy("label").agg(F.min("least").alias("least"), F.min("first").alias("first"))
    linked = mine.select("fp", "label").join(best, "label").select("fp", "least", "first")
    alone = fps.join(label.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "least", "first")
    out = materialize(linked.unionAll(alone).withColumnRenamed("least", "component_id"), "components")
    discard(fps, links, label, *used)
    return prints, out


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document row.

    Rows with equal fingerprints are linked, also those of empty texts (fingerprint zero). Null ids get a row, but are
    no component's id: one of null ids only has a null id. Repeated rows each get a row; extra columns are not read; an
    empty table gives an empty one.
    """
    prints, component = groups(docs)
    return prints.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = STAGE_SHINGLE, words: int = STAGE_WORDS, least: float = STAGE_LEAST, bits: int = STAGE_BITS) -> DataFrame:
    """One document of each group, that of the smallest id (of repeated ids, the smallest hash of text); columns as docs has them.

    Links are those of `words` fingerprints of shingles of `size` words at `bits` bits, if the shingles are `least` similar. Null ids come last; null and empty texts are
    one group. Of repeated rows one stays, whichever of them. Extra columns, whatever their names, are kept.
    """
    prints, component = groups(docs, size, words, least, bits)
    first = component.select(F.col("first.doc_id").alias("d"), F.col("first.th").alias("h")).distinct().withColumn("lead", F.lit(True))
    each = prints.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    judged = each.join(first, each["doc_id"].eqNullSafe(first["d"]) & (each["th"] == first["h"]), "left")
    d, h, lead = fresh(docs, "other_id", "other_hash", "lead")
    marked = judged.select(F.col("doc_id").alias(d), F.col("th").alias(h), F.coalesce("lead", F.lit(False)).alias(lead), "n")
    marked = materialize(marked.where(~F.col(lead) | (F.col("n") > 1)).drop("n"), "not-kept")
    discard(prints, component)
    joined = docs.join(small_side(marked), docs["doc_id"].eqNullSafe(marked[d]) & (F.xxhash64(docs["text"]) == marked[h]), "left")
    cols = [docs[f"`{c}`"] for c in docs.columns]
    single = joined.where(marked[lead].isNull()).select(*cols)
    repeated = joined.where(marked[lead]).dropDuplicates([d, h]).select(*cols)
    return single.unionByName(repeated)
