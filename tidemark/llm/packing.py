"""Best-fit packing of documents into sequences by swap-based local search.

Only lengths decide how pieces go together, and there are at most LIMIT different ones. So the search runs on the
histogram of lengths, whatever the number of documents: bins of equal contents are one entry with a multiplicity. The
driver holds that table alone. Pieces then find their slots by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches

LIMIT, END = 1024, 2
#: Rows that are ranked together at most, about.
RANK_ROWS = 200_000
CACHED_WORDS = 150_000
#: Rounds of equal swaps without effect after which the search ends.
PATIENCE = 8


@cache
def encoder(vocabulary: str = "byte_bpe_50k"):
    """Text to little-endian 32-bit ids, equal to those of the tokenizer file vocabulary.json.

    The same vocabulary's rank file gives the same ids faster. Where single spaces stand between words, words are
    independent of each other: those met first are cached, and the others of a text are encoded in one call and told
    apart by the ids that begin with a space. Texts with the file's special token go through the file.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    file = public_tokenizers.path(f"{vocabulary}.json")
    with open(file) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cache
    def full():  # few texts need it, and it is large
        from tokenizers import Tokenizer

        return Tokenizer.from_file(file)

    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    spaces = [f" {chr(c)}" for c in range(0x3001) if chr(c).isspace()]
    known: dict[str, bytes] = {}
    plain = lambda text: np.array(fast(text), dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(full().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if any(s in text for s in spaces):
            return plain(text)
        first, *rest = text.split(" ")
        out = list(map(known.get, rest))
        if None in out:
            new = [i for i, v in enumerate(out) if v is None]
            ids = np.array(fast(" " + " ".join([rest[i] for i in new])), dtype="<u4")
            at = np.flatnonzero(begins[ids])
            if len(at) != len(new):
                return plain(text)
            raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
            for i, a, b in zip(new, (at * 4).tolist(), ends):
                out[i] = raw[a:b]
            if len(known) < CACHED_WORDS:
                known.update((rest[i], out[i]) for i in new)
        return plain(first) + b"".join(out)

    return encode


def pieces(docs: DataFrame, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document row.

    A document is its ids and then id 2, so an empty or null text has one id. Only documents of more than limit ids
    are cut; the first piece is the short one, if any is. Repeated rows each have their pieces; extra columns aren't read.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + (n % limit or limit) if piece == 0 else at + limit
                    part = ids[4 * at : 4 * to]
                    for column, v in zip(rows, (doc, piece, at, to - at, zlib.crc32(part), part), strict=False):
                        column.append(v)
                    at, piece = to, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows)])

    return source.mapInArrow(run, schema)


def best_fit(counts: dict[int, int], limit: int) -> Counter:
    """Best fit of decreasing lengths: contents (lengths, descending) to their number of bins."""
    open_bins: dict[int, Counter] = {}  # free space: contents: number
    frees: list[int] = []
    done: Counter = Counter()

    def put(free: int, what: tuple, n: int) -> None:
        if free == 0:
            done[what] += n
            return
        if free not in open_bins:
            open_bins[free] = Counter()
            frees.insert(bisect_left(frees, free), free)
        open_bins[free][what] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(frees, length)
            if i == len(frees):
                each = limit // length
                full, rest = divmod(left, each)
                if full:
                    put(limit - each * length, (length,) * each, full)
                if rest:
                    put(limit - rest * length, (length,) * rest, 1)
                break
            free = frees[i]
            what, n = next(iter(open_bins[free].items()))
            fit = min(free // length, left)
            use = min(n, left // fit)
            open_bins[free][what] -= use
            if not open_bins[free][what]:
                del open_bins[free][what]
                if not open_bins[free]:
                    del open_bins[free]
                    frees.pop(i)
            put(free - fit * length, what + (length,) * fit, use)
            left -= use * fit
    for bins in open_bins.values():
        done.update(bins)
    return done


def _parts(b: tuple) -> list[tuple]:
    """The different choices of one or two items."""
    return [*{(x,) for x in b}, *set(combinations(b, 2))]


def _swap(b: tuple, out: tuple, into: tuple) -> tuple:
    left = list(b)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def local_search(bins: Counter, limit: int) -> Counter:
    """Empty bins by swaps between underfull bins, each of which increases the sum of squared fills.

    When no such swap is left, every underfull bin makes one equal swap with a full bin, as `equal_swaps` says, and the
    search goes on; it ends at the lower bound, when no equal swap is left, or when PATIENCE rounds of them in a row let it
    empty no further bin.
    """
    least = -(-sum(sum(b) * n for b, n in bins.items()) // limit)
    bins, idle = _search(bins, limit, least), 0
    while sum(bins.values()) > least and idle < PATIENCE:
        swapped = equal_swaps(bins, limit)
        if swapped == bins:
            break
        further = _search(swapped, limit, least)
        idle = 0 if sum(further.values()) < sum(bins.values()) else idle + 1
        bins = further
    return bins


def equal_swaps(bins: Counter, limit: int) -> Counter:
    """Exchange one or two items of each underfull bin so that it becomes full and a full one lacks what it lacked.

    The sum of squared fills stays. Of all swaps with full bins the one is made that leaves the smallest items (by sum of
    squares) in the bin that is underfull after it, if these are smaller than before: small items find takers.
    """
    out = Counter(bins)
    full: dict[int, dict[tuple[tuple, tuple], int]] = {}  # sum of one or two items: (contents, items): squares of the rest
    for b in bins:
        if sum(b) == limit and len(b) > 1:
            for p in _parts(b):
                full.setdefault(sum(p), {})[b, p] = sum(x * x for x in b) - sum(x * x for x in p)
    for giver in sorted((b for b in bins if sum(b) < limit), key=lambda b: (sum(b), b)):
        free, found = limit - sum(giver), None
        weight = sum(x * x for x in giver)
        for given in _parts(giver):
            fine = sum(x * x for x in given)
            for (b, returned), rest in full.get(sum(given) + free, {}).items():
                if rest + fine < weight and out[b] and (found is None or (rest + fine, b) < found[:2]):
                    found = (rest + fine, b, given, returned)
        if found is None:
            continue
        _, b, given, returned = found
        n = min(out[giver], out[b])
        for old, new in ((giver, _swap(giver, given, returned)), (b, _swap(b, returned, given))):
            out[old] -= n
            out[new] += n
    return +out


def _search(bins: Counter, limit: int, least: int) -> Counter:
    """The emptiest bin gives: an item moves to where it fits best, or one or two of its items are exchanged for one or
    two that are smaller together. All bins of its contents do so at once, as far as there are takers. A bin that can
    give nothing more rests until takers of new contents come up. Ends at the lower bound or when all rest; as the sum of
    squares grows with each exchange, it does end.
    """
    start, bins = bins, Counter()
    count = sum(start.values())
    born: dict[tuple, int] = {}  # underfull contents, the oldest first: number of their arrival
    tried: dict[tuple, int] = {}  # arrivals that a giver has seen without use
    waiting: list[tuple[int, tuple]] = []  # a heap of givers
    rested: set[tuple] = set()
    clock = 0

    def add(b: tuple, n: int) -> None:
        nonlocal clock
        before = bins[b]
        bins[b] += n
        if sum(b) < limit and (not before or before == 1):  # a second one can take from the first
            clock += 1
            born.pop(b, None)
            born[b] = clock
            if not before:
                tried.pop(b, None)
                rested.discard(b)
                heappush(waiting, (sum(b), b))
            while rested:
                r = rested.pop()
                heappush(waiting, (sum(r), r))

    def take(b: tuple, n: int) -> None:
        bins[b] -= n
        if not bins[b]:
            del bins[b], born[b]
            rested.discard(b)

    for b, n in start.items():
        add(b, n)
    while count > least and waiting:
        low, giver = heappop(waiting)
        if giver not in born or giver in rested:
            continue
        best = None  # (gain, fill after, taker, given, returned)
        gives = _parts(giver)
        since = tried.get(giver, 0)
        for taker in reversed(born):
            if born[taker] <= since:
                break
            if taker == giver and bins[giver] < 2:
                continue
            fill = sum(taker)
            free = limit - fill
            returns = _parts(taker)
            for given in gives:
                for returned in chain(returns, [()] if len(given) == 1 else []):
                    d = sum(given) - sum(returned)
                    if 0 < d <= free and (gain := 2 * d * (fill - low + d)) > 0 and (best is None or (gain, fill + d) > best[:2]):
                        best = (gain, fill + d, taker, given, returned)
        if best is None:
            tried[giver] = clock
            rested.add(giver)
            continue
        _, _, taker, given, returned = best
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        take(giver, n)
        take(taker, n)
        if giver in born:
            heappush(waiting, (low, giver))
        rest = _swap(giver, given, returned)
        if rest:
            add(rest, n)
        else:
            count -= n
        add(_swap(taker, returned, given), n)
    return bins


def slots(bins: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, sequence ids of these, and offsets; rank r of a length has sequence id + (r - first rank)."""
    found: dict[int, list] = {}
    used: Counter = Counter()
    base = 0
    for what, n in sorted(bins.items(), reverse=True):
        at = 0
        for length in what:
            found.setdefault(length, []).append((used[length], base, at))
            used[length] += n
            at += length
        base += n
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in found.items()}


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """cut (a written table of pieces) with sequence_id and offset. Equal pieces of repeated rows may change places."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most limit rows
    bins = local_search(best_fit(counts, limit), limit)
    table = slots(bins)
    # groups of a length are ranked apart, each well under a task's share of the rows, however frequent the length is
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(RANK_ROWS, max(1, sum(counts.values()) // (4 * parts)))
    salts = [max(1, -(-counts.get(k, 0) // most)) for k in range(limit + 1)]
    of_length = F.get(F.expr(f"array({', '.join(map(str, salts))})"), F.col("length").cast("int"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of_length))
    # ranks of a length: offsets of its salts, then places within a salt
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("place", place).join(F.broadcast(sizes) if sum(salts) <= 1 << 18 else sizes, ["length", "salt"]).withColumn("rank", F.col("place") - 1 + F.col("before")).drop("salt", "place", "before")
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                rows = length == k
                first, base, at = table[int(k)]
                i = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows] = base[i] + rank[rows] - first[i]
                offset[rows] = at[i]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in names], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(materialize(pieces(docs, limit, keep_ids), "pieces"), limit)
