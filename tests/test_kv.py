import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom
from tidemark.sources import kv
from tidemark.sources.frames import FrameLog
from tidemark.streaming.changes import mirror, mirrored

RUNS = [(b"a", b"v1-old", 0, 1), (b"b", b"v2", 0, 1), (b"c", b"v3-old", 0, 1), (b"a", b"v1-new", 0, 2), (b"c", None, 1, 2), (b"d", b"v4", 0, 2)]


def plain(df):
    return sorted((bytes(r["key"]), r["value"] and bytes(r["value"]), r["op"]) for r in df.collect())


def test_compaction(spark):
    runs = spark.createDataFrame([(bytearray(k), v and bytearray(v), o, f) for k, v, o, f in RUNS], "key binary, value binary, op tinyint, file_id int")
    assert plain(kv.compact(runs, False)) == [(b"a", b"v1-new", 0), (b"b", b"v2", 0), (b"c", None, 1), (b"d", b"v4", 0)]
    assert plain(kv.compact(runs, True)) == [(b"a", b"v1-new", 0), (b"b", b"v2", 0), (b"d", b"v4", 0)]


def test_store(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}")
    assert s.scan().count() == 0 and s.compact().created == ()
    kv.load(s, [(b"a", b"1"), (b"b", b"2"), (b"a", None), (b"a", b"3"), (b"\xff\x00", b"x"), (b"\x7f", None)])
    assert [k for k, _ in s.iterate()] == [b"a", b"b", b"\xff\x00"] and s.get(b"a") == b"3"
    with pytest.raises(kv.KeyMissing):
        s.get(b"\x7f")
    again = kv.KVStore(spark, f"file://{tmp_path}")
    assert again.segment == 2 and again.get(b"b") == b"2"
    s.flush()
    kv.load(s, [(b"b", None), (b"c", b"4")])
    s.flush()
    assert plain(s.scan(deletes=True)) == [(b"a", b"3", 0), (b"b", None, 1), (b"c", b"4", 0), (b"\x7f", None, 1), (b"\xff\x00", b"x", 0)]
    done = s.compact()
    assert done.keys == 3 and len(s.runs()) == 1 and [k for k, _ in s.iterate()] == [b"a", b"c", b"\xff\x00"]
    kv.load(s, [(k, None) for k, _ in list(s.iterate())])
    s.flush()
    assert s.compact().created == () and s.runs() == []


def test_partial_compaction_keeps_newer_values(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}")
    for v in (b"old1", b"old2", b"NEW"):
        kv.load(s, [(b"k", v), (v, b"x")])
        s.flush()
    one, two, three = s.runs()
    done = s.compact(kv.Task((one, two), (1, 2)))
    assert s.runs() == [one, two, three] and s.get(b"k") == b"NEW" and done.obsolete == (one, two)
    s.install(done)
    assert len(s.runs()) == 2 and s.runs()[-1] == three and s.get(b"k") == b"NEW" and s.get(b"old1") == b"x"
    with pytest.raises(ValueError):
        s.install(done)
    again = kv.KVStore(spark, f"file://{tmp_path}")
    assert again.get(b"k") == b"NEW" and again.segment == 4 and again.lookup(again.runs()[0], b"k") == ("value", b"old2")


def test_run_outcomes_and_corruption(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}")
    kv.load(s, [(b"a", b"1"), (b"c", b""), (b"e", b"3"), (b"b", None)])
    run = s.flush()
    assert [s.lookup(run, k) for k in (b"a", b"b", b"c", b"zz")] == [("value", b"1"), ("deleted", None), ("value", b""), ("absent", None)]
    assert all(s.may_contain(run, k) for k in (b"a", b"b", b"c", b"e")) and s.open_run(run).count() == 4
    part = next((tmp_path / "runs" / run).rglob("*.parquet"))
    good = part.read_bytes()
    for crc in (tmp_path / "runs" / run).rglob(".*.crc"):
        crc.unlink()
    part.write_bytes(good[: len(good) // 2])
    with pytest.raises(kv.RunCorrupt):
        s.open_run(run)
    with pytest.raises(kv.RunCorrupt):
        s.lookup(run, b"a")
    with pytest.raises(kv.RunCorrupt):
        s.compact()
    assert s.store.names("runs") == [run]
    part.unlink()
    with pytest.raises(kv.RunCorrupt):
        s.open_run(run)
    (tmp_path / "runs" / run / "_SUCCESS").unlink()
    with pytest.raises(kv.RunCorrupt):
        s.open_run(run, verify=False)


def test_failed_compaction_leaves_nothing(spark, tmp_path, monkeypatch):
    s = kv.KVStore(spark, f"file://{tmp_path}")
    kv.load(s, [(b"a", b"1")])
    run = s.flush()
    monkeypatch.setattr(kv.bloom, "build", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.compact()
    assert s.store.names("runs") == [run] and s.get(b"a") == b"1"


def test_rollover_closes_files_by_size(spark, tmp_path):
    rows = [(bytearray(b"%04d" % i), bytearray(b"v" * (i % 50)), 0) for i in range(500)]
    kv.write_run(spark.createDataFrame(rows, kv.RUN).repartition(3), f"{tmp_path}/run", 400)
    got = kv.read_run(spark, f"{tmp_path}/run").collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((bytes(r["key"]), len(r["value"]) + 11))
    want, now = {}, {}
    for part in {f[:6] for f in files}:  # by hand: a file ends with the entry that fills it
        now, k, size = sorted(x for f, xs in files.items() if f[:6] == part for x in xs), 0, 0
        for x in now:
            want.setdefault(f"{part}-{k:06d}", []).append(x)
            size += x[1]
            if size >= 400:
                k, size = k + 1, 0
    assert {f: sorted(x) for f, x in files.items()} == want and len(got) == 500 and len(files) > 20
    ends = sorted((min(x)[0], max(x)[0]) for x in files.values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_small_files_have_small_bloom_filters(spark, tmp_path):
    rows = [(bytearray(b"%016d" % (i * 7919)), bytearray(b"v" * 60), 0) for i in range(60)]
    kv.write_run(spark.createDataFrame(rows, kv.RUN), f"{tmp_path}/run", 1000)
    sizes = [p.stat().st_size for p in (tmp_path / "run").rglob("*.parquet")]
    assert len(sizes) >= 4 and max(sizes) < 10_000
    from pyarrow.parquet import ParquetFile  # the filters are there: data pages and footer alone take less

    part = next((tmp_path / "run").rglob("*.parquet"))
    meta = ParquetFile(part).metadata
    assert part.stat().st_size - meta.serialized_size - sum(meta.row_group(0).column(c).total_compressed_size for c in range(3)) > 250
    assert kv.read_run(spark, f"{tmp_path}/run").count() == 60


def test_bloom(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").cast("binary").alias("key"))
    added, shape = keys.where("CAST(CAST(key AS STRING) AS INT) % 2 = 0"), bloom.Shape.of(10_000)
    words = bloom.build(added, shape)
    out = bloom.may_contain(keys, words, shape).select(F.expr("CAST(CAST(key AS STRING) AS INT) % 2 = 0").alias("in"), "may").groupBy("in").agg(F.avg(F.col("may").cast("int")).alias("p")).collect()
    p = {r["in"]: r["p"] for r in out}
    assert p[True] == 1 and p[False] <= 0.02
    assert not bloom.may_contain(keys.limit(1), words.limit(0), shape).first()["may"]


def test_log_rotates_by_size(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}", segment_bytes=100)
    kv.load(s, [(b"k%d" % i, b"x" * 30) for i in range(7)] + [(b"big", b"y" * 500), (b"k0", b"last")])
    assert len(s.segments()) == 6 and s.get(b"k0") == b"last" and s.scan().count() == 8


def test_frame_log(spark, tmp_path):
    log = FrameLog(spark, f"file://{tmp_path}/wal", segment_bytes=30)
    for i in range(12):
        log.append(b"seq", b"%d" % i)
        log.append(b"k%d" % i, op=kv.DELETE)
    assert log.commit() == log.segments() and len(log.segments()) == 12 and log.commit() == []
    full = log.replay()
    assert full.count() == 24 and plain(kv.live(full, F.struct("segment", "offset"))) == [(b"seq", b"11", 0)]
    assert log.recover() == {}
    broken = tmp_path / "wal" / log.segments()[4]
    data = bytearray(broken.read_bytes())
    data[-1] ^= 1
    (tmp_path / "wal" / f".{broken.name}.crc").unlink()
    broken.write_bytes(bytes(data))
    assert log.replay().count() == 23 and log.recover() == {broken.name: len(kv.pack_frame(b"k4", b"", kv.DELETE))} and log.recover() == {}
    assert log.replay().count() == 23 and len(log.segments()) == 12
    assert FrameLog(spark, f"file://{tmp_path}/none").replay().count() == 0


def test_size_and_limits(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}", cap=20)
    s.put(b"k", b"v")
    assert s.size == 2
    s.put(b"k2", b"v222222222")
    assert s.size == 14
    s.put(b"k", b"v5555")
    assert s.size == 18
    with pytest.raises(kv.StoreFull):
        s.put(b"k3", b"too long")
    assert s.size == 18 and b"k3" not in s.buffer
    s.delete(b"k")
    assert s.size == 13
    for bad in (b"", b"x" * 70_000):
        with pytest.raises(ValueError):
            s.put(bad, b"")
    for bad in (((), ()), (("a",), (1, 2)), (("a", "b"), (1, 1))):
        with pytest.raises(ValueError):
            kv.Task(*bad)


def test_frames(spark):
    good = kv.pack_frame(b"k", b"v") + kv.pack_frame(b"k", b"", kv.DELETE)
    bad = bytearray(kv.pack_frame(b"z", b"w"))
    bad[-1] ^= 1
    assert kv.unpack_frames(good + bytes(bad)) == ([(0, b"k", b"v"), (1, b"k", b"")], len(good))
    assert kv.unpack_frames(good[:-3])[1] == len(kv.pack_frame(b"k", b"v"))
    body = spark.createDataFrame([(bytearray(b"key"), bytearray(b"value"), 1)], "key binary, value binary, op tinyint")
    row = body.select(kv.body(F.col("key"), F.col("value"), F.col("op")).alias("b"), kv.crc(F.col("key"), F.col("value"), F.col("op")).alias("c")).first()
    assert bytes(row["b"]) == b"\x01\x03\x00keyvalue" and row["c"] == zlib.crc32(row["b"])


def test_stream(spark, tmp_path):
    s = kv.KVStore(spark, f"file://{tmp_path}/kv")
    for k in range(2):
        kv.load(s, [(b"a", b"%d" % k), *([] if k else [(b"b", b"x"), (b"c", None)])])
        mirror(spark, f"{tmp_path}/kv/log", f"file://{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert plain(mirrored(spark, f"file://{tmp_path}/out")) == [(b"a", b"1", 0), (b"b", b"x", 0), (b"c", None, 1)]
    assert len(list((tmp_path / "out" / "v=000000000001").glob("bucket=*"))) == 1
    assert mirrored(spark, f"file://{tmp_path}/none").count() == 0
