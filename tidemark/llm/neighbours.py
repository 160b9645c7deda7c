"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so that the largest cosine is the least Euclidean distance. A table's hash is
M floors of (projection + shift) / WIDTH on Gaussian directions. A query visits its own bucket and perturbed ones (each
coordinate moved by -1, 0 or 1) in the order of their estimated success: the sum of squared distances to the walls that
are crossed, smallest first. Candidates of all tables are scored exactly, in double precision, on the original vectors.

Equal vectors are hashed once, with the smallest different ids that can be among the nearest (K + 1): more can't come
into a result, so a vector that a third of all rows hold costs one entry. Queries for which the probes find fewer than
K ids are scored against all vectors, in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, small_side

K, EVERY = 5, 50
#: Tables, hash functions of each, bucket width and probes of a table: chosen for a recall of over 0.9 on vectors
#: without any cluster structure, the hardest case.
TABLES, M, WIDTH, PROBES, SEED = 12, 6, 1.2, 130, 5
BLOCK = 512  # queries scored against a bucket at once
HEAVY = 8192  # members of a bucket that one task holds, about
EXACT = 4096  # queries scored against all vectors in a pass, about


def _hashes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((TABLES, dim, M)), rng.uniform(0, WIDTH, (TABLES, M))


def _keys(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit number of a bucket; different buckets may share one, which only adds candidates."""
    h = np.full(cells.shape[:-1], table + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            h = (h ^ (cells[..., j].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows whose vector isn't null, empty or zero and holds no null, NaN or infinity."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & fine)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, queries being the ids divisible by every.

    Rank is by score, ties by the smaller id; a query of fewer than k candidates gets them all. Repeated ids are
    candidates each and queries once for each row's vector. A candidate is never of the query's id. Vectors of another
    length than most are compared among themselves. Extra columns are not read.
    """
    small_batches(vectors.sparkSession)
    good = materialize(usable(vectors), "vectors")
    out = None
    for (dim,) in good.groupBy(F.size("v")).count().orderBy("count").select("size(v)").collect():
        part = _search(good.where(F.size("v") == dim), dim, k, every)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(good: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    directions, shifts = _hashes(dim)
    moves = np.array(list(product((-1, 0, 1), repeat=M)))
    # the k + 1 smallest ids of a vector: ranks within salted parts first, so that a hot vector is not one task's
    n_salts = 64
    part = W.partitionBy("v", F.pmod("vec_id", F.lit(n_salts))).orderBy("vec_id")
    fewer = good.select("vec_id", "v").distinct().withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    least = fewer.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    asked = materialize(good.where(F.col("vec_id") % every == 0).distinct().select(F.col("v"), F.array("vec_id").alias("ids")), "queries")
    both = distinct.select(F.lit(0).alias("kind"), "ids", "v").unionByName(asked.select(F.lit(1).alias("kind"), "ids", "v"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                if not part.num_rows:
                    continue
                x = _vectors(part.column(2))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                kind = part.column(0).to_numpy(zero_copy_only=False)
                rows, keys = [], []
                for t in range(TABLES):
                    p = (x @ directions[t] + shifts[t]) / WIDTH
                    cell = np.floor(p)
                    rest = p - cell
                    plain = np.flatnonzero(kind == 0)
                    rows.append(plain)
                    keys.append(_keys(cell[plain], t))
                    ask = np.flatnonzero(kind == 1)
                    if len(ask):
                        f = rest[ask]
                        cost = np.where(moves[None] < 0, f[:, None] ** 2, np.where(moves[None] > 0, (1 - f[:, None]) ** 2, 0)).sum(2)
                        best = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES] if len(moves) > PROBES else np.broadcast_to(np.arange(len(moves)), cost.shape)
                        rows.append(np.repeat(ask, best.shape[1]))
                        keys.append(_keys(cell[ask][:, None] + moves[best], t).ravel())
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[c.take(pa.array(rows)) for c in part.columns]], names=["key", "kind", "ids", "v"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, salt, kind): members of a bucket, then its visitors. Each visitor's best are kept for the whole task."""
        found: dict[int, dict[int, float]] = {}
        members: list[tuple[np.ndarray, list]] = []  # of the bucket at hand: vectors and ids
        ready, now = None, None

        def visit(q_ids: list, q: np.ndarray) -> None:
            nonlocal ready
            if ready is None:
                x = np.concatenate([m[0] for m in members])
                ready = x, np.linalg.norm(x, axis=1), [i for m in members for i in m[1]]
            for at in range(0, len(q_ids), BLOCK):
                _keep(found, q_ids[at : at + BLOCK], q[at : at + BLOCK], *ready, k)

        for b in batches:
            if not b.num_rows:
                continue
            key, salt, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists, x = b.column(3).to_pylist(), _vectors(b.column(4))
            new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *new], [*new, b.num_rows], strict=True):
                if (key[s], salt[s]) != now:
                    now, members, ready = (key[s], salt[s]), [], None
                if kind[s] == 0:
                    members.append((x[s:e], lists[s:e]))
                elif members:
                    visit([i[0] for i in lists[s:e]], x[s:e])
        yield _rows(found, k)

    placed = both.mapInArrow(place, "key long, kind int, ids array<long>, v array<double>")
    # buckets of many members are split by salt, and their visitors go to every part: parts' results merge
    heavy = placed.where("kind = 0").groupBy("key").count().where(F.col("count") > HEAVY).select("key", F.ceil(F.col("count") / HEAVY).cast("int").alias("parts"))
    heavy = materialize(heavy, "heavy-buckets")
    split = placed.join(small_side(heavy), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    each = F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    split = split.select("key", F.explode(each).alias("salt"), "kind", "ids", "v")
    found = split.repartition("key", "salt").sortWithinPartitions("key", "salt", "kind").mapInArrow(score, "query_id long, vec_id long, score double")
    near = materialize(_ranked(found, k), "near")
    few = near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    asked = asked.select(F.col("ids")[0].alias("query_id"), "v")
    lacking = materialize(asked.join(few, "query_id", "left_anti"), "lacking-queries")
    n_passes = -(-lacking.count() // EXACT)
    if not n_passes:
        return near
    out = near.join(few, "query_id", "left_semi")
    for i in range(n_passes):
        rows = lacking.where(F.pmod(F.xxhash64("query_id"), F.lit(n_passes)) == i).collect()
        if rows:
            out = out.unionByName(materialize(_exact(distinct, [r["query_id"] for r in rows], np.array([r["v"] for r in rows]), k), "exact"))
    return out


def _keep(found: dict, q_ids: list, q: np.ndarray, x: np.ndarray, norms: np.ndarray, ids: list, k: int) -> None:
    """Put the vectors x nearest to each of q, with k + 1 different ids if there are, and ties of the last, into found."""
    s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * norms)
    first = min(len(x), k + 1)
    top = np.argpartition(-s, first - 1, axis=1)[:, :first] if first < len(x) else np.broadcast_to(np.arange(first), (len(q), first))
    for i, query in enumerate(q_ids):
        mine = found.setdefault(query, {})
        # equals of the last score taken may be tied: all of them are looked at
        take, cut = first, s[i, top[i]].min()
        near = np.flatnonzero(s[i] >= cut - 1e-12)
        while take < len(x) and len({c for j in near for c in ids[j]}) <= k:  # rows of the same ids fill the places
            take = min(len(x), 2 * take)
            cut = -np.partition(-s[i], take - 1)[take - 1]
            near = np.flatnonzero(s[i] >= cut - 1e-12)
        for j in near:
            for c in ids[j]:
                if c != query:
                    mine[c] = max(s[i, j], mine.get(c, -2.0))
        if len(mine) > 16 * (k + 1):
            found[query] = dict(sorted(mine.items(), key=lambda e: (-e[1], e[0]))[: 2 * (k + 1)])


def _rows(found: dict, k: int) -> pa.RecordBatch:
    rows = [(q, c, v) for q, mine in found.items() for c, v in sorted(mine.items(), key=lambda e: (-e[1], e[0]))[: 2 * (k + 1)]]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    near = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(distinct: DataFrame, q_ids: list, q: np.ndarray, k: int) -> DataFrame:
    """The k nearest of all vectors for each of the queries."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, float]] = {}
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                ids, x = part.column(0).to_pylist(), _vectors(part.column(1))
                norms = np.linalg.norm(x, axis=1)
                for at in range(0, len(q_ids), BLOCK):
                    _keep(found, q_ids[at : at + BLOCK], q[at : at + BLOCK], x, norms, ids, k)
        yield _rows(found, k)

    return _ranked(distinct.select("ids", "v").mapInArrow(score, "query_id long, vec_id long, score double"), k)
