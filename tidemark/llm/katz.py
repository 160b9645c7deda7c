"""LM scoring by Katz backoff: Good-Turing discounted bigram counts, exactly normalised backoff weights.

Tokens are words split at ASCII white space, A-Z lower-cased, and an end at each text's end; a start stands before it.
For a history h and a token w:

    p(w | h) = d(c) c / (C(h) + 1/2)  where the bigram was counted c times, d(c) the Good-Turing discount
    p(w | h) = weight(h) q(w)         otherwise; q is the discounted unigram distribution
    weight(h) = (1 - sum of p(v | h) over counted v) / (1 - sum of q(v) over counted v)

The half keeps something for words not counted after h even where no count of h is discounted. q keeps the Good-Turing share of unseen tokens for one unknown token. Unknown histories have weight 1.

Four written tables, each made from the ones before:

    chunks     texts of about CHUNK tokens together, as numbers of the chunk's words
    counts     for each chunk, the training counts of its different words and bigrams. These are 64-bit hashes, dealt
               by hash to buckets as packed arrays, so that a row is many of them and a frequent one is in each chunk
               once; one chunk of those that a bigram was trained in owns it
    scored     each document's sums over counted bigrams, and the histories of the others; each chunk's sums of p and
               q of the bigrams that it owns, by history
    histories  backoff weights, from these sums

Buckets grow in number with the corpus, so a bucket's size stays about BUCKET hashes. Two different bigrams of one
bucket and of equal 48-bit hash would be counted as one: less than one pair in a hundred buckets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, discard, materialize, small_batches, small_side

FOLDS, CUT, SPARE = 10, 5, 0.5
#: Tokens of a chunk (a longer text is a chunk of its own), and hashes of a bucket.
CHUNK, BUCKET = 500_000, 2_000_000
#: Bytes of a hash that are sent within a bucket.
KEY_BYTES = 6
#: The first two numbers of each chunk's words.
START, END = 0, 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, n_tokens, doc_id and held and end (arrays by document: end is where the next one begins), words (hashes), tokens (numbers of words)."""
    small_batches(docs.sparkSession)
    held = bucket_of(F.col("doc_id"), FOLDS) == 0
    source = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, fold, ends, parts, size = _Numbers({None: START, b" ": END}), [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            h = xxhash.xxh64_intdigest
            words = np.array([0, 0, *[h(w) for w in list(numbers)[2:]]], dtype=np.uint64)
            words[:2] = 1, 2
            row = [random.SystemRandom().getrandbits(62), size, ids, fold, ends, words.tobytes(), np.concatenate(parts).tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["chunk", "n_tokens", "doc_id", "held", "end", "words", "tokens"])

        for b in batches:
            for i, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ws = t.as_py().lower().split()
                if size and size + len(ws) > CHUNK:
                    yield chunk()
                    numbers, ids, fold, ends, parts, size = _Numbers({None: START, b" ": END}), [], [], [], [], 0
                parts += [np.fromiter(map(numbers.__getitem__, ws), np.uint32, len(ws)), np.array([END], np.uint32)]
                size += len(ws) + 1
                ids.append(i)
                fold.append(f)
                ends.append(size)
        if size:
            yield chunk()

    return source.mapInArrow(run, "chunk long, n_tokens long, doc_id array<long>, held array<boolean>, end array<long>, words binary, tokens binary")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


class _Chunk:
    """A row of chunks: its tokens and histories, and its different words and bigrams, in the order of buckets."""

    def __init__(self, held: list, end: list, words: bytes, tokens: bytes, buckets: int):
        self.words = np.frombuffer(words, np.uint64)
        self.b = np.frombuffer(tokens, np.uint32).astype(np.int64)
        self.held, end = np.array(held, dtype=bool), np.array(end, dtype=np.int64)
        self.begin = np.concatenate([[0], end[:-1]])
        self.sizes = end - self.begin
        self.a = np.concatenate([[START], self.b[:-1]])
        self.a[self.begin] = START
        v = len(self.words)
        pairs, self.at = np.unique(self.a * v + self.b, return_inverse=True)
        self.pair_a, self.pair_b = pairs // v, pairs % v
        train = np.repeat(~self.held, self.sizes)
        n = np.concatenate([np.bincount(self.b[train], minlength=v), np.bincount(self.at[train], minlength=len(pairs))])
        mixed = _mix(self.words)
        # the lowest bit tells bigrams from words
        keys = np.concatenate([mixed & ~np.uint64(1), _mix(mixed[self.pair_a] * np.uint64(0x9E3779B97F4A7C15) + mixed[self.pair_b]) | np.uint64(1)])
        bucket = ((keys >> np.uint64(8 * KEY_BYTES - 8)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.keys, self.n = bucket[self.order], keys[self.order], n[self.order]

    def edges(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]]))

    def back(self, in_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by word and by bigram."""
        out = np.empty_like(in_order)
        out[self.order] = in_order
        return out[: len(self.words)], out[len(self.words) :]


def _narrow(n: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more follow as 64-bit numbers."""
    large = n[n >= 255]
    return len(large).to_bytes(4, "little") + np.minimum(n, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def _wide(b: bytes) -> np.ndarray:
    k = int.from_bytes(b[:4], "little")
    out = np.frombuffer(b, np.uint8, len(b) - 4 - 8 * k, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(b, "<u8", k, len(b) - 8 * k)
    return out


def _low(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES bytes of each key; the bucket is taken from the others and tells them apart."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _high(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8")[:, 0]


def _count(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every entry of a bucket twice its key's sum, plus 1 where it owns the key; the different keys and their sums."""
    k, m = np.concatenate(keys), np.concatenate(n)
    names, at = np.unique(k, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at, m)
    trained = np.flatnonzero(m)
    out = 2 * total[at]
    out[trained[np.unique(at[trained], return_index=True)[1]]] += 1
    return out, names, total


def counts(parts: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, c (packed) of every chunk and bucket; and for each bucket a row without chunk of freq (by kind and count r up to CUT + 1: how many) and total tokens and kinds of words."""
    small_batches(parts.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = _Chunk(r["held"], r["end"], r["words"], r["tokens"], buckets)
                e = x.edges()
                cut = list(zip(e[:-1], e[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x.bucket[i]) for i, _ in cut], pa.int32()), pa.array([r["chunk"]] * len(cut), pa.int64()), pa.array([_low(x.keys[i:j]) for i, j in cut], pa.binary()), pa.array([_narrow(x.n[i:j]) for i, j in cut], pa.binary())],
                    names=["bucket", "chunk", "keys", "n"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whose, keys, n = None, [], [], []
        schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("c", pa.binary()), ("freq", pa.list_(pa.int64())), ("total", pa.int64()), ("kinds", pa.int64())])

        def done() -> pa.RecordBatch:
            c, names, total = _count(keys, n)
            pair = (names & np.uint64(1)).astype(bool)
            freq = [np.bincount(np.minimum(total[k], CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist() for k in (~pair, pair)]
            cut = np.cumsum([len(k) for k in keys])[:-1]
            rows = [{"chunk": w, "bucket": now, "c": _narrow(p)} for w, p in zip(whose, np.split(c, cut))]
            rows.append({"bucket": now, "freq": freq[0] + freq[1], "total": int(total[~pair].sum()), "kinds": int((total[~pair] > 0).sum())})
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for bucket, chunk, k, m in zip(*[c.to_pylist() for c in b.columns]):
                if bucket != now and keys:
                    yield done()
                    whose, keys, n = [], [], []
                now = bucket
                whose.append(chunk)
                keys.append(_high(k))
                n.append(_wide(m))
        if keys:
            yield done()

    dealt = parts.select("chunk", "held", "end", "words", "tokens").mapInArrow(deal, "bucket int, chunk long, keys binary, n binary")
    return dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(count, "chunk long, bucket int, c binary, freq array<long>, total long, kinds long")


def _discounts(counts: dict[int, int], cut: int = CUT) -> dict[int, float]:
    """Good-Turing discounts of counts up to cut, as Katz has them; where counts of counts give none in (0, 1), 1 - 1 / (count + 1) ** 2 stands in."""
    n = lambda r: counts.get(r, 0)
    common = (cut + 1) * n(cut + 1) / n(1) if n(1) else 1.0
    out = {}
    for r in range(1, cut + 1):
        d = (((r + 1) * n(r + 1) / (r * n(r))) - common) / (1 - common) if n(r) and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 1 / (r + 1) ** 2
    return out


class Model:
    """A fitted model: n tokens, v kinds of them, discounts, and the tables of the module's head.

    The tables cover the documents it was fitted with, training ones and held-out ones. Chunks and counts are deleted
    once these are scored.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.chunks = materialize(chunks(docs), "lm-chunks")
        tokens = self.chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tokens // BUCKET + 1)
        self.counts = materialize(counts(self.chunks, self.buckets), "lm-counts")
        got = self.counts.where("chunk IS NULL").agg(*[F.coalesce(F.sum(F.get("freq", F.lit(i))), F.lit(0)) for i in range(2 * CUT + 2)], F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        self.n, self.v = got[-2:]
        freq = [{r + 1: got[s + r] for r in range(CUT + 1)} for s in (0, CUT + 1)]
        self.d1, self.d2 = map(_discounts, freq)
        left = sum(r * (1 - self.d1[r]) * freq[0][r] for r in self.d1)  # what discounts take away
        # where nothing was discounted, half a token is left for the unknown
        self.scale = (self.n - 0.5) / self.n if self.n and left < 0.5 else 1.0
        self.unknown = 1 - (self.n - left) * self.scale / self.n if self.n else 1.0
        self.scored = materialize(self._scored(), "lm-scored")
        discard(self.counts, self.chunks)
        sums = self.scored.where("kind = 1").select(F.inline(F.arrays_zip("a", "p", "q"))).groupBy("a").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        self.histories = materialize(sums.select("a", "p", "q", ((1 - F.col("p")) / (1 - F.col("q"))).alias("weight")), "lm-histories")

    def _scored(self) -> DataFrame:
        n, v, scale, unknown, buckets = self.n, self.v, self.scale, self.unknown, self.buckets
        d1, d2 = (np.array([0.0, *[d[r] for r in sorted(d)], 1.0]) for d in (self.d1, self.d2))
        schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("i", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("a", pa.list_(pa.int64())), ("p", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))])

        def documents(r: dict, x: _Chunk) -> list[dict]:
            got = sorted(r["got"], key=lambda g: g["bucket"])
            word, pair = x.back(np.concatenate([_wide(g["c"]) for g in got]))
            c, own, c2 = word >> 1, (pair & 1).astype(bool), pair >> 1
            c_a = c.copy()
            c_a[START] = c[END]  # as many starts as ends
            q = np.where(c > 0, d1[np.minimum(c, CUT + 1)] * c * scale / max(n, 1), unknown)
            p = d2[np.minimum(c2, CUT + 1)] * c2 / (c_a[x.pair_a] + SPARE)
            value = np.log10(np.where(c2 > 0, p, q[x.pair_b]))
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            new = (c2 == 0)[x.at]
            add = lambda y: np.add.reduceat(y, x.begin)
            names = x.words.view(np.int64)
            cut = np.cumsum(add(new.astype(np.int64)))[:-1]
            unseen = np.split(names[x.a[new]], cut)
            cols = [r["doc_id"], x.held.tolist(), x.sizes.tolist(), add((c > 0)[x.b].astype(np.int64)).tolist(), add(base[x.b]).tolist(), add(value[x.at]).tolist()]
            out = [{"kind": 0, "chunk": r["chunk"], "i": i, "doc_id": d, "held": f, "n_tokens": m, "n_known": k, "base": s, "score": t, "a": u.tolist()} for i, (d, f, m, k, s, t, u) in enumerate(zip(*cols, unseen))]
            if own.any():
                at = x.pair_a[own]
                size = len(x.words)
                has = np.flatnonzero(np.bincount(at, minlength=size))
                out.append({"kind": 1, "a": names[has].tolist(), "p": np.bincount(at, p[own], size)[has].tolist(), "q": np.bincount(at, q[x.pair_b[own]], size)[has].tolist()})
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    yield pa.RecordBatch.from_pylist(documents(r, _Chunk(r["held"], r["end"], r["words"], r["tokens"], buckets)), schema)

        small_batches(self.chunks.sparkSession)
        # one chunk's counts: as many as it has words and bigrams, whatever the corpus
        mine = self.counts.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "c")).alias("got"))
        both = self.chunks.join(mine.hint("merge"), "chunk")
        return both.select("chunk", "doc_id", "held", "end", "words", "tokens", "got").mapInArrow(run, "kind int, chunk long, i long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double, a array<long>, p array<double>, q array<double>")


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end alone. Null ids are training rows. Repeated rows count each in training and get a
    row each. Extra columns are not read. Without any training row every token is unknown. A model given is one that
    was fitted with docs.
    """
    m = model or Model(docs)
    each = m.scored.where("kind = 0")
    # bigrams that were not counted: only held-out documents have them
    new = each.where(F.size("a") > 0).select("chunk", "i", F.explode("a").alias("a")).groupBy("chunk", "i", "a").count()
    fixed = new.join(small_side(m.histories.select("a", "weight")), "a").groupBy("chunk", "i").agg(F.sum(F.col("count") * F.log10("weight")).alias("more"))
    return each.join(fixed, ["chunk", "i"], "left").select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
