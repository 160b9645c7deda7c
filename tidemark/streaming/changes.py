"""The change log as a stream: segments are a file source, each batch is merged latest-wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import latest
from ..sources.files import Store
from ..sources.kv import LOG

BUCKETS = 64
STATE = "key binary, value binary, op tinyint, at struct<segment: bigint, offset: bigint>, bucket int"


def follow(spark: SparkSession, log: str) -> DataFrame:
    """A streaming DataFrame of log records as segments are committed."""
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(log)


def _places(store: Store, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket, after all batches or those before one."""
    names = [n for n in store.names("") if n.endswith(".json") and (before is None or int(n[:-5]) < before)]
    return {int(k): v for k, v in json.loads(store.read(names[-1])).items()} if names else {}


def _state(spark: SparkSession, store: Store, places: dict[int, str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("basePath", store.root).parquet(*[store.full(f"{v}/bucket={k}") for k, v in sorted(places.items())]).drop("v")


def mirror(spark: SparkSession, log: str, target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest record of every key in target, dealt to buckets by key; a batch rewrites the buckets that it touches.

    A batch's buckets stand in a folder of its own, and count once its list of places is written; run again, a batch is
    written again with the same result.
    """
    store = Store(spark, target)
    store.make("")

    def merge(batch: DataFrame, n: int) -> None:
        new = batch.select("key", "value", "op", F.struct("segment", "offset").alias("at"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        if not touched:
            return
        places = _places(store, n)
        old = _state(spark, store, {k: v for k, v in places.items() if k in touched})
        last = new.unionByName(old).groupBy("bucket", "key").agg(F.max_by(F.struct("value", "op", "at"), "at").alias("x")).select("key", "x.*", "bucket")
        last.write.mode("overwrite").partitionBy("bucket").parquet(store.full(f"v={n:012d}"))
        store.commit(f"{n:012d}.json", json.dumps(places | {k: f"v={n:012d}" for k in touched}))

    return follow(spark, log).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mirrored(spark: SparkSession, target: str) -> DataFrame:
    """The mirror's records, deletes included."""
    store = Store(spark, target)
    return _state(spark, store, _places(store)).select("key", "value", "op")


__all__ = ["follow", "latest", "mirror", "mirrored"]
