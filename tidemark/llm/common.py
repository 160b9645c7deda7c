"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about; a longer text is a batch of its own.
BATCH_BYTES = "8m"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: A word of ASCII digits, ASCII lower-case letters and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words in text of any case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named in spark.checkpoint.dir; without it a local master gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # shuffle files and broadcasts of tables written before go when the driver collects its garbage
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for t in tables:
        p, fs = _hadoop_path(t.sparkSession, t._tidemark_path)
        fs.delete(p, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def raw_words(text: Column) -> Column:
    """Words in the case of the text (upper-case letters count as letters); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP + "+"), "")


class Sieve:
    """A bit table that lets hashes of a bounded key set pass, and few others: a prefilter before a join.

    It prunes only keys that can't join, so results don't depend on its size. The table is a literal of at most
    `limit` bytes. Keys are hashed with murmur3 over lower-cased words, which only adds passes: words equal under
    ASCII lower-casing are equal under lower() too.
    """

    def __init__(self, keys: DataFrame, limit: int = 1 << 20):
        """keys: one column `words`, arrays of words."""
        n = keys.distinct().count()
        self.size = min(limit, 1 << max(10, (16 * n).bit_length()))
        hit = keys.select(F.transform("words", lambda x: F.lower(x)).alias("w"))
        k = hit.select(F.max(F.size("w"))).first()[0] or 1
        rows = hit.select((F.hash(*[F.get("w", F.lit(i)) for i in range(k)]).bitwiseAND(F.lit(self.size - 1))).alias("b")).distinct().toArrow()
        bits = np.zeros(self.size, np.uint8)  # at most `limit` places, so as many rows
        bits[rows.column(0).to_numpy()] = 1
        self.bits = bits.tobytes()

    def passes(self, *words: Column) -> Column:
        at = F.hash(*[F.lower(w) for w in words]).bitwiseAND(F.lit(self.size - 1))
        return F.substring(F.lit(self.bits), at + 1, F.lit(1)) == F.lit(b"\x01")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids count as bucket 1, so as training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(1))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that long texts keep workers' memory bounded. The one setting holds for every operator."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, by its counted rows as a hashed relation holds them, up to which a join may broadcast it; beyond it Spark's own strategies hold.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row of a few numbers in a hashed relation.
ROW_BYTES = 120


def small_side(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough. df should be cheap to count (a written table)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
