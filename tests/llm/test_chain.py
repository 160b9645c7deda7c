"""The pipeline on a small table against a brute-force chain: nulls, repeats, a large group of copies, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import WORDS, distance_one, naive_score, stage_keeps, words

import corpus_pipeline
from tidemark.llm import lines, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, lead int, other_id long"
SPLIT = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+[^0-9A-Za-z\x80-\U0010ffff]*")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    text = lambda: "\n".join(line(r.randrange(4, 30)) for _ in range(5))
    copied, passage, other = text(), line(12), line(9)
    texts = [text() if i % 4 else "".join(c + "#&" for c in line(40)) for i in range(60)]
    texts += [copied] * 40 + [None, "", text() + "\n" + passage, text() + "\n" + passage + "\n" + other, texts[5].replace(" ", "  ", 1)]
    near = texts[6].split(" ")
    near[7] = "changed"
    texts.append(" ".join(near))
    rows = [(i, t, "en", "s", 1, 0.5, "x", 3, 9) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, text(), *rows[0][2:]), (500, copied, None, None, None, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("chain"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, other), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(i):
    return (i is not None, i or 0)


def drop_lines(rows):
    places = sorted({(key(i), k, x, t) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()})
    seen, gone = [], set()
    for i, k, x, t in places:
        w = x.split(" ")
        if any(w == v or min(len(w), len(v)) >= lines.MIN_WORDS and distance_one(w, v) for v in seen):
            gone.add((i, k, t))
        seen.append(w)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (key(i), k, t) not in gone)) for i, t in rows]


def drop_benchmark(rows, items):
    grams = {(i, tuple(w[p : p + min(8, len(w))])) for i, t in items for w in [words(t)] if w for p in range(len(w) - min(8, len(w)) + 1)}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, g in grams:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(item)
        if len(found) < 2:
            out.append((i, t if not hit else t[: SPLIT.search(t).start()] + "".join(u for k, u in enumerate(SPLIT.findall(t)) if k not in hit)))
    return out


def test_chain(spark, folder):
    docs, labels, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    net = quality.train(docs, labels)
    good = [r for r in rows if naive_score(net, (r[1] or "").encode()) >= 0.3]
    assert 0 < len(good) < len(rows)
    want = drop_lines(good)
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in good)
    kept = stage_keeps(want)
    assert len(kept) < len(want) - 40
    last = drop_benchmark(kept, [(r["item_id"], r["text"]) for r in items.collect()])
    assert {t for _, t in last} != {t for _, t in kept}
    encode, pieces = packing.encoder(), Counter()
    for i, t in last:
        ids = np.frombuffer(encode(t or "") + (2).to_bytes(4, "little"), "<u4")
        assert len(ids) <= 1024
        pieces[(i, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for bin_ in by.values():
        at = 0
        for offset, n in sorted(bin_):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_on_empty_and_odd_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, docs, folder)
        assert name == "best_fit_packing" or out.columns == docs.columns
