"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into windows of 8 bytes that overlap by half, over the whole text. Learned
filters score each window; scores are max-pooled over chunks of 256 bytes, and the chunks are combined by their mean
and their maximum into one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_of, fresh, small_batches

EMBED, BLOCK, CHUNK, FILTERS = 8, 4, 256, 24
PER_CHUNK = CHUNK // BLOCK
#: The network is fitted on at most this many labelled documents, those of the smallest hashes, taken in the order of
#: their hashes up to this many bytes of text in all. No text is left out or cut for its own length.
TRAIN_DOCS, TRAIN_BYTES = 3000, 24 << 20
EPOCHS, STEPS, BATCH, RATE, SEED = 12, 500, 48, 0.004, 11  # at least so many epochs and steps
SLAB = 1024  # chunks worked on at once: bounds memory however long a text is
FOLDS, THRESHOLD = 5, 0.3


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    head: np.ndarray  # (BLOCK * EMBED, FILTERS): first half of the window
    tail: np.ndarray  # second half
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    base: float

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.head, self.tail, self.bias, self.out]


def new_network(rate: float) -> Network:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Network(draw(256, EMBED, by=0.5), draw(BLOCK * EMBED, FILTERS, by=0.2), draw(BLOCK * EMBED, FILTERS, by=0.2), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, by=0.1), float(np.log(rate / (1 - rate))))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole chunks (one at least), one block more at the end; chunks of each text."""
    chunks = np.array([len(t) // CHUNK + 1 for t in texts], dtype=np.int64)
    flat = np.zeros(int(chunks.sum()) * CHUNK + BLOCK, dtype=np.uint8)
    at = 0
    for t, n in zip(texts, chunks, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * CHUNK
    return flat, chunks


def _windows(net: Network, x: np.ndarray, c: int, d: int, last: np.ndarray) -> np.ndarray:
    """Filter scores of the windows of chunks c to d, by chunk; x: their embedded blocks and one more.

    A text's last window has zeros for its second half, not the next text's bytes.
    """
    z = (x[:-1] @ net.head + x[1:] @ net.tail).reshape(d - c, PER_CHUNK, FILTERS)
    ends = last[(last >= c) & (last < d)] - c
    z[ends, -1] = x[ends * PER_CHUNK + PER_CHUNK - 1] @ net.head + np.tile(net.embed[0], BLOCK) @ net.tail
    return z


def pooled(net: Network, flat: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Max-pooled filter scores of every chunk."""
    total, last = int(chunks.sum()), np.cumsum(chunks) - 1
    out = np.empty((total, FILTERS), np.float32)
    for c in range(0, total, SLAB):
        d = min(total, c + SLAB)
        x = net.embed[flat[c * CHUNK : d * CHUNK + BLOCK]].reshape(-1, BLOCK * EMBED)
        _windows(net, x, c, d, last).max(1, out=out[c:d])
    return out


def features(net: Network, scores: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    act = np.maximum(scores + net.bias, 0)
    mean = np.add.reduceat(act, starts, axis=0) / chunks[:, None]
    top = np.maximum.reduceat(act, starts, axis=0)
    return act, mean, top


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    flat, chunks = lay_out(texts)
    _, mean, top = features(net, pooled(net, flat, chunks), chunks)
    z = np.concatenate([mean, top], 1).astype(np.float64) @ net.out.astype(np.float64) + net.base
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the log loss. Without both classes the answer is a constant: the smoothed share of label 1."""
    n, ones = len(labels), float(labels.sum())
    net = new_network((ones + 1) / (n + 2))
    if ones in (0, n):
        net.out[:] = 0
        return net
    rng = np.random.default_rng(SEED)
    params = net.params()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    mb = vb = 0.0
    epochs = max(EPOCHS, -(-STEPS // max(1, n // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            batch = [texts[i] for i in rows]
            flat, chunks = lay_out(batch)
            total = int(chunks.sum())
            scores, best = _forward(net, flat, chunks)
            act, mean, top = features(net, scores, chunks)
            feat = np.concatenate([mean, top], 1)
            p = 1 / (1 + np.exp(-np.clip(feat @ net.out + net.base, -40, 40)))
            dz = ((p - labels[rows]) / len(rows)).astype(np.float32)
            owner = np.repeat(np.arange(len(rows)), chunks)
            d_mean, d_top = dz[:, None] * net.out[:FILTERS], dz[:, None] * net.out[FILTERS:]
            is_top = act == top[owner]
            share = is_top / np.maximum(1, np.add.reduceat(is_top.astype(np.float32), np.concatenate([[0], np.cumsum(chunks)[:-1]]), axis=0))[owner]
            g = ((d_mean / chunks[:, None])[owner] + d_top[owner] * share) * (act > 0)
            first = best + (np.arange(total) * PER_CHUNK)[:, None]  # the block each best window begins with
            then = first + 1
            then[(best == PER_CHUNK - 1) & np.isin(np.arange(total), np.cumsum(chunks) - 1)[:, None]] = total * PER_CHUNK  # the zeros at the end
            d_head, d_tail, d_embed = np.zeros_like(net.head), np.zeros_like(net.tail), np.zeros_like(net.embed)
            for c in range(0, total, SLAB):
                mine = g[c : c + SLAB]
                for blocks, w, d_w in ((first, net.head, d_head), (then, net.tail, d_tail)):
                    ids = flat[(blocks[c : c + SLAB] * BLOCK)[:, :, None] + np.arange(BLOCK)]  # (chunks, FILTERS, BLOCK)
                    d_w += np.einsum("cfd,cf->df", net.embed[ids].reshape(*ids.shape[:2], -1), mine, optimize=True)
                    d_x = (mine[:, :, None] * w.T[None]).reshape(-1, EMBED)
                    for e in range(EMBED):
                        d_embed[:, e] += np.bincount(ids.ravel(), d_x[:, e], 256).astype(np.float32)
            grads = [d_embed, d_head, d_tail, g.sum(0), feat.T @ dz]
            t += 1
            for k, (p_, g_) in enumerate(zip(params, grads, strict=True)):
                g_ = g_ + 1e-4 * p_ * (k == 4)
                m[k] = 0.9 * m[k] + 0.1 * g_
                v[k] = 0.999 * v[k] + 0.001 * g_ * g_
                p_ -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            gb = float(dz.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            net.base -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return net


def _forward(net: Network, flat: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk scores and their best windows."""
    total, last = int(chunks.sum()), np.cumsum(chunks) - 1
    scores, best = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.int64)
    for c in range(0, total, SLAB):
        d = min(total, c + SLAB)
        z = _windows(net, net.embed[flat[c * CHUNK : d * CHUNK + BLOCK]].reshape(-1, BLOCK * EMBED), c, d, last)
        best[c:d] = z.argmax(1)
        scores[c:d] = np.take_along_axis(z, best[c:d][:, None], 1)[:, 0]
    return scores, best


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """text (bytes) and y of the bounded sample, in one partition."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(bucket_of(F.col("doc_id"), FOLDS) != 0)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", (F.col("y") > 0).cast("double").alias("y"))
    rows = rows.orderBy("h", "doc_id", "text").limit(2 * train_docs)  # more than train_docs only where ids are repeated
    before = F.sum(F.octet_length("text")).over(W.orderBy("h", "doc_id", "text").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < train_bytes).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network:
    """Fit on labelled documents outside the held-out fold, in one task; the driver gets the parameters alone.

    Of labels with null ids or quality nothing is learned; ids labelled twice count with their lowest label, documents
    with repeated ids with each text, null texts as empty ones. The sample is chosen by hash among all labels and
    bounded in rows and in bytes overall, so it never depends on a text's own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += [t.as_py() for t in b.column(0)]
            ys += b.column(1).to_pylist()
        net = fit(texts, np.array(ys))
        yield pa.RecordBatch.from_arrays([pa.array([[p.astype("<f4").tobytes() for p in net.params()]]), pa.array([net.base])], names=["params", "base"])

    small_batches(docs.sparkSession)
    got = training_rows(docs, labels, train_docs, train_bytes).mapInArrow(run, "params array<binary>, base double").collect()
    if not got:  # no rows, hence no partition that ran
        return fit([], np.zeros(0))
    net = new_network(0.5)
    for mine, p in zip(net.params(), got[0]["params"], strict=True):
        mine[...] = np.frombuffer(p, "<f4").reshape(mine.shape)
    net.base = got[0]["base"]
    return net


def classify(docs: DataFrame, net: Network, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs' columns (or those named), and last the score, 0 to 1, under a name that they don't have.

    Null texts score as empty ones; every row, repeated ones too, is scored over its whole text.
    """
    small_batches(docs.sparkSession)
    keep = columns or docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    schema = kept.drop("bytes").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [v.as_py() for v in b.column(b.num_columns - 1)]
            out, part, size = [], [], 0
            for t in texts:  # groups of bounded size
                part.append(t)
                size += len(t)
                if size > 1 << 22:
                    out.append(score_texts(net, part))
                    part, size = [], 0
            out.append(score_texts(net, part))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out))], names=[*b.schema.names[:-1], "score"])

    return kept.mapInArrow(run, schema).toDF(*keep, name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row.

    Null ids are not held out; null and empty texts have the score of an empty text; repeated rows each get a row;
    without documents the result is empty, without usable labels every score is one constant. Extra columns are not read.
    """
    scored = classify(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier doesn't reject, with docs' columns, whatever their names.

    Rows with null ids or texts are judged as all others, a null text as an empty one; repeated rows go or stay
    together; an empty table gives an empty one.
    """
    (name,) = fresh(docs, "score")
    return classify(docs, train(docs, labels), name=name).where(F.col(name) >= THRESHOLD).drop(name)
