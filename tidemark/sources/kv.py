"""An ordered key-value store on Parquet: a change log, latest-wins reads, sorted runs and compaction.

Every key is non-empty and at most MAX_KEY bytes; keys are ordered by their unsigned bytes. A delete is a record too.

A numbered manifest names the runs with their age, newest largest, and the first log segment that is not in a run. What
a manifest doesn't name does not exist for readers, so flush and compaction take effect at once or not at all. A
compaction's result is as old as its newest input, so runs that are newer still win over it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bloom
from ..operators.keyed import DELETE, ENTRY, PUT, compact, entry_bytes, latest, live, rollover
from .files import Store
from .frames import MAX_FRAME, MAX_KEY, SEGMENT_BYTES, check_key, pack_frame, unpack_frames

LOG = "key binary, value binary, op tinyint, segment long, offset long"
RUN = "key binary, value binary, op tinyint"
#: Bytes of entries after which a run's file is closed, unless a run is written with another number.
FILE_BYTES = 256 << 20


class KeyMissing(KeyError):
    pass


class StoreFull(RuntimeError):
    pass


class RunCorrupt(RuntimeError):
    """A run whose files don't hold what the manifest says."""


def write_run(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """A sorted run: files of consecutive key ranges, sorted inside, closed at file_bytes, with Parquet's Bloom filters on the key.

    Filters are made for as many keys as a file can hold; without a number each takes Parquet's largest, 1 MB.
    """
    ranges = df.repartitionByRange("key").sortWithinPartitions("key")
    out = rollover(ranges, file_bytes).write.option("parquet.bloom.filter.enabled#key", "true")
    out.option("parquet.bloom.filter.expected.ndv#key", str(1 + file_bytes // (ENTRY + 1))).partitionBy("file").parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """key, value, op and file of a written run."""
    return spark.read.schema(RUN + ", file string").parquet(path)


def crc(key: Column, value: Column, op: Column) -> Column:
    """CRC-32 of a log frame's body, by built-in functions."""
    return F.crc32(body(key, value, op))


def body(key: Column, value: Column, op: Column) -> Column:
    """op:1, key length:2, key, value; numbers little-endian."""
    return F.concat(_little(op, 1), _little(F.octet_length(key), 2), key, F.coalesce(value, F.lit(b"")))


def _little(c: Column, n: int) -> Column:
    h = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (n - i) - 1, 2) for i in range(n)]))


@dataclass(frozen=True)
class Task:
    """A compaction: run names with their file ids, newest largest."""

    inputs: tuple[str, ...]
    file_ids: tuple[int, ...]
    bottom: bool = False

    def __post_init__(self):
        if not self.inputs:
            raise ValueError("a compaction needs an input")
        if len(self.inputs) != len(self.file_ids):
            raise ValueError("each input needs a file id")
        if len(set(self.file_ids)) < len(self.file_ids):
            raise ValueError("file ids must differ")


@dataclass(frozen=True)
class Run:
    """A manifest's entry: age is the file id, check the sum of the entries' checksums, shape that of the Bloom filter."""

    name: str
    age: int
    entries: int
    check: int
    bits: int
    hashes: int

    @property
    def shape(self) -> bloom.Shape:
        return bloom.Shape(self.bits, self.hashes)


@dataclass(frozen=True)
class Result:
    """A compaction's outcome: runs written, runs they replace, number of keys. Takes effect with KVStore.install."""

    created: tuple[str, ...]
    obsolete: tuple[str, ...]
    keys: int
    run: Run | None = None


class KVStore:
    """A writer's buffer over log segments and sorted runs in one folder.

    Records are buffered; commit() appends them as segments of at most segment_bytes (a larger record alone), each
    written whole or not at all. cap bounds the buffered keys and values in bytes: a write over it is refused and
    changes nothing, and flush() makes room.
    """

    def __init__(self, spark: SparkSession, root: str, cap: int = 32 << 20, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES):
        self.spark, self.store, self.cap = spark, Store(spark, root), cap
        self.segment_bytes, self.file_bytes = segment_bytes, file_bytes
        for d in ("log", "runs", "blooms", "manifests"):
            self.store.make(d)
        self.buffer: dict[bytes, tuple[int, bytes | None]] = {}
        self.pending: list[tuple[bytes, bytes | None, int]] = []
        self.size = 0
        self.segment = max(self._manifest()[2], 1 + max((int(n[8:]) for n in self.store.names("log")), default=0))

    # -- the manifest

    def _manifest(self) -> tuple[int, list[Run], int]:
        """Version, runs and the first segment that is not in a run."""
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        if not names:
            return 0, [], 1
        raw = json.loads(self.store.read(f"manifests/{names[-1]}"))
        return int(names[-1][:-5]), [Run(**r) for r in raw["runs"]], raw["from"]

    def _commit_manifest(self, version: int, runs: list[Run], start: int) -> None:
        text = json.dumps({"runs": [asdict(r) for r in runs], "from": start})
        if not self.store.commit(f"manifests/{version:012d}.json", text):
            raise OSError("the store was changed by another writer")

    def runs(self) -> list[str]:
        return [r.name for r in sorted(self._manifest()[1], key=lambda r: r.age)]

    def segments(self) -> list[str]:
        """Committed segments that are not in a run: those with Spark's success mark. A broken write leaves none and is passed over."""
        start = self._manifest()[2]
        return [n for n in self.store.names("log") if int(n[8:]) >= start and self.store.exists(f"log/{n}/_SUCCESS")]

    # -- writes

    def _put(self, key: bytes, value: bytes | None, op: int) -> None:
        check_key(key)
        old = self.buffer.get(key)
        was = len(key) + len(old[1] or b"") if old else 0
        size = self.size - was + len(key) + len(value or b"")
        if op == PUT and size > self.cap:
            raise StoreFull(f"{size} bytes are over the cap of {self.cap}")
        if op == DELETE and old and old[0] == DELETE:
            return
        self.buffer[key], self.size = (op, value), size
        self.pending.append((key, value, op))

    def put(self, key: bytes, value: bytes) -> None:
        self._put(key, value, PUT)

    def delete(self, key: bytes) -> None:
        self._put(key, None, DELETE)

    def commit(self) -> None:
        """Make the pending records durable; what a failure leaves unwritten stays pending."""
        while self.pending:
            n, size = 0, 0
            while n < len(self.pending):
                key, value, _ = self.pending[n]
                size += len(key) + len(value or b"") + 11
                if n and size > self.segment_bytes:
                    break
                n += 1
            rows = [(bytearray(k), None if v is None else bytearray(v), op, self.segment, i) for i, (k, v, op) in enumerate(self.pending[:n])]
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(self.store.full(f"log/segment-{self.segment:012d}"))
            self.segment += 1
            del self.pending[:n]

    # -- reads

    def replay(self) -> DataFrame:
        """All committed log records that are not in a run."""
        names = self.segments()
        if not names:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[self.store.full(f"log/{n}") for n in names])

    def _run(self, name: str) -> Run:
        for r in self._manifest()[1]:
            if r.name == name:
                return r
        raise KeyError(f"unknown run {name}")

    def _path(self, name: str) -> str:
        return self.store.full(f"runs/{name}")

    def open_run(self, name: str, verify: bool = True) -> DataFrame:
        """A run's rows. With verify they are read once and compared with the manifest; raises RunCorrupt."""
        run = self._run(name)
        if not self.store.exists(f"runs/{name}/_SUCCESS"):
            raise RunCorrupt(f"{name}: its files are missing or were not written to the end")
        df = read_run(self.spark, self._path(name))
        if verify:
            try:
                n, keys, check, odd = self._summary(df).first()
            except (PySparkException, Py4JJavaError) as e:
                raise RunCorrupt(f"{name}: its files can't be read") from e
            if odd:
                raise RunCorrupt(f"{name}: {odd} entries have an unknown operation or no key")
            if (n, keys, check) != (run.entries, run.entries, run.check):
                raise RunCorrupt(f"{name}: {n} entries of {keys} keys with checksum {check}, not {run.entries} with {run.check}")
        return df

    @staticmethod
    def _summary(df: DataFrame) -> DataFrame:
        fine = F.col("op").isin(PUT, DELETE) & (F.octet_length("key") > 0)
        check = F.coalesce(F.sum(crc(F.col("key"), F.col("value"), F.col("op"))), F.lit(0))
        return df.agg(F.count("*"), F.count_distinct("key"), check, F.count_if(~F.coalesce(fine, F.lit(False))))

    def may_contain(self, name: str, key: bytes) -> bool:
        """The run's Bloom filter: False only if the key is not in the run."""
        run = self._run(name)
        words = self.spark.read.schema("word long, bits long").parquet(self.store.full(f"blooms/{name}"))
        probe = self.spark.range(1).select(F.lit(bytearray(key)).alias("key"))
        at = {int(p) // 64 for p in probe.select(bloom.places(F.col("key"), run.shape)).first()[0]}
        return bloom.may_contain(probe, words.where(F.col("word").isin(sorted(at))), run.shape).first()["may"]

    def lookup(self, name: str, key: bytes) -> tuple[str, bytes | None]:
        """One run's answer: ("value", bytes), ("deleted", None) or ("absent", None); raises RunCorrupt if it can't be told."""
        check_key(key)
        if not self.may_contain(name, key):
            return "absent", None
        try:
            rows = self.open_run(name, verify=False).where(F.col("key") == F.lit(bytearray(key))).limit(2).collect()
        except (PySparkException, Py4JJavaError) as e:
            raise RunCorrupt(f"{name}: its files can't be read") from e
        if not rows:
            return "absent", None
        if len(rows) > 1 or rows[0]["op"] not in (PUT, DELETE):
            raise RunCorrupt(f"{name}: a key stands twice or has an unknown operation")
        return ("deleted", None) if rows[0]["op"] == DELETE else ("value", bytes(rows[0]["value"] or b""))

    def _all(self) -> DataFrame:
        """Runs and log with one order: runs are older than the log that is left."""
        log = self.replay().select("key", "value", "op", F.struct(F.lit(1).alias("t"), F.col("segment").alias("n"), F.col("offset").alias("o")).alias("at"))
        for r in self._manifest()[1]:
            run = read_run(self.spark, self._path(r.name))
            log = log.unionAll(run.select("key", "value", "op", F.struct(F.lit(0).alias("t"), F.lit(r.age).cast("long").alias("n"), F.lit(0).cast("long").alias("o")).alias("at")))
        return log

    def scan(self, deletes: bool = False) -> DataFrame:
        """A snapshot in key order, of what is committed."""
        out = latest(self._all(), F.col("at"))
        return (out if deletes else out.where(F.col("op") == PUT)).orderBy("key")

    def get(self, key: bytes) -> bytes:
        check_key(key)
        if key in self.buffer:
            op, value = self.buffer[key]
        else:
            row = latest(self._all().where(F.col("key") == F.lit(bytearray(key))), F.col("at")).first()
            op, value = (row["op"], row["value"]) if row else (DELETE, None)
        if op == DELETE:
            raise KeyMissing(key)
        return bytes(value)

    def iterate(self) -> Iterator[tuple[bytes, bytes]]:
        for r in self.scan().toLocalIterator():
            yield bytes(r["key"]), bytes(r["value"])

    # -- runs

    def _write(self, df: DataFrame, age: int) -> Run | None:
        """Write a run and its filter, which no manifest names yet; None and no files if it would be empty."""
        n = 1 + max((int(x[4:]) for x in self.store.names("runs")), default=0)
        name = f"run-{n:012d}"
        try:
            write_run(df, self._path(name), self.file_bytes)
            rows = read_run(self.spark, self._path(name))
            entries, _, check, _ = self._summary(rows).first()
            shape = bloom.Shape.of(entries)
            if entries:
                bloom.build(rows, shape).write.parquet(self.store.full(f"blooms/{name}"))
        except Exception:
            self._remove(name)
            raise
        if not entries:
            self._remove(name)
            return None
        return Run(name, age, entries, check, shape.bits, shape.hashes)

    def _remove(self, name: str) -> None:
        self.store.remove(f"runs/{name}")
        self.store.remove(f"blooms/{name}")

    def flush(self) -> str | None:
        """The log as a new sorted run, the newest; its segments go afterwards. None without records."""
        self.commit()
        version, runs, _ = self._manifest()
        names = self.segments()
        if not names:
            return None
        last = int(names[-1][8:])
        run = self._write(latest(self.replay(), F.struct("segment", "offset")), 1 + max((r.age for r in runs), default=0))
        self._commit_manifest(version + 1, [*runs, run], last + 1)
        for n in self.store.names("log"):
            if int(n[8:]) <= last:
                self.store.remove(f"log/{n}")
        self.buffer.clear()
        self.size = 0
        return run.name

    def compact(self, task: Task | None = None, bottom: bool = True) -> Result:
        """Merge runs into one. A caller's task is only written: its result takes effect with install(). Without a task
        all runs are merged and the result is installed."""
        own = task is None
        if own:
            runs = self._manifest()[1]
            if not runs:
                return Result((), (), 0)
            task = Task(tuple(r.name for r in runs), tuple(r.age for r in runs), bottom)
        parts = [self.open_run(n).withColumn("file_id", F.lit(i)) for n, i in zip(task.inputs, task.file_ids, strict=True)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        run = self._write(compact(every, task.bottom), max(task.file_ids))
        result = Result((run.name,) if run else (), task.inputs, run.entries if run else 0, run)
        if own:
            self.install(result)
        return result

    def install(self, result: Result) -> None:
        """Put a compaction's run in the place of its inputs, in one step; then delete the inputs."""
        version, runs, start = self._manifest()
        if not {*result.obsolete} <= {r.name for r in runs}:
            raise ValueError("an input of the compaction is no run any more")
        kept = [r for r in runs if r.name not in result.obsolete]
        self._commit_manifest(version + 1, [*kept, *([result.run] if result.run else [])], start)
        for n in result.obsolete:
            self._remove(n)


def load(store: KVStore, records: Iterable[tuple[bytes, bytes | None]]) -> None:
    """Put records; a value of None deletes."""
    for k, v in records:
        if v is None:
            store.delete(k)
        else:
            store.put(k, v)
    store.commit()


__all__ = ["DELETE", "KVStore", "KeyMissing", "LOG", "MAX_FRAME", "MAX_KEY", "PUT", "Result", "Run", "RunCorrupt", "StoreFull", "Task", "body", "check_key", "compact", "crc", "entry_bytes", "latest", "live", "load", "pack_frame", "read_run", "unpack_frames", "write_run"]
