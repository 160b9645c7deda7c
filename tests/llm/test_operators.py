"""Each operator against a brute-force version on small tables with nulls, ties, repeats, long texts and extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import decontaminate, html, katz, licenses, lines, neighbours, packing, quality, simhash, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row long, length long"
WORDS = [a + b for a in ("al", "be", "ce", "du", "fo") for b in ("ra", "né", "Tix", "mo", "s,", "k9")]
BASE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return BASE.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    shared = [line(n) for n in (6, 9, 30)]
    out = [None, "", " \n\t", "one", "One two\nthree", "GNU General Public License gnu general public license", "Licensed under CC BY-NC 4.0. MIT License; apache\nlicense", line(4000)]
    for i in range(60):
        own = [line(r.randrange(1, 25)) for _ in range(4)]
        extra = r.choice(shared).split(" ")
        if i % 3 == 0:
            extra[r.randrange(len(extra))] = "changed"
        if i % 5 == 0:
            extra.pop(r.randrange(len(extra)))
        own.insert(r.randrange(4), " ".join(extra))
        out.append("\n".join(own))
    copy = out[-1].split(" ")
    copy[3] = "other"
    return [*out, out[20], out[20], " ".join(copy)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, 0.5, "x", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here at all", *rows[0][2:]), (3, "id again", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (quality.digest(none, labels), urls.judge(pages), lines.digest(none), licenses.scan(none), katz.score(none), simhash.digest(none), neighbours.search(vectors), decontaminate.digest(none, items), packing.packed(none), html.main_texts(pages)):
        assert df.count() == 0
    assert decontaminate.digest(docs, items).where("n_items > 0").count() == 0
    assert quality.digest(docs, labels).where("predicted = 1 AND score > 0").count() == docs.count()


def test_quality(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        ws = [r.choice(WORDS) for _ in range(r.randrange(20, 200))]
        rows.append((i, " ".join(w if good else w + r.choice(("###", "&&&")) for w in ws)))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, "x" * 300_000), (None, "y")]
    labels += [(None, 1, 0), (900, None, 0)]
    out = quality.digest(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 240]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    assert np.mean([x["predicted"] == (x["doc_id"] % 3 > 0) for x in held]) > 0.9


def test_quality_covers_the_whole_text():
    net = quality.fit([b"a b c d " * 30, b"a b c d " * 30 + b"###&&&" * 40] * 30, np.array([1.0, 0.0] * 30))
    clean, late = quality.score_texts(net, [b"a b c d " * 3000, b"a b c d " * 3000 + b"###&&&" * 2000])
    assert late < clean
    one = [quality.score_texts(net, [t])[0] for t in (b"", b"x" * 256, b"y" * 99_999)]
    assert np.allclose(one, quality.score_texts(net, [b"", b"x" * 256, b"y" * 99_999]), atol=1e-5)


def naive_score(net, text):
    """One text's score by the definition: every window of every filter, the best of each chunk, mean and maximum of the chunks."""
    chunks = len(text) // quality.CHUNK + 1
    padded = text + bytes(chunks * quality.CHUNK + quality.BLOCK - len(text))
    best = []
    for c in range(chunks):
        scores = []
        for start in range(c * quality.CHUNK, (c + 1) * quality.CHUNK, quality.BLOCK):
            window = np.concatenate([net.embed[b] for b in padded[start : start + 2 * quality.BLOCK]]).astype(np.float64)
            scores.append(window @ np.concatenate([net.head, net.tail]).astype(np.float64))
        best.append(np.maximum(np.max(scores, axis=0) + net.bias, 0))
    z = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)]) @ net.out + net.base
    return 1 / (1 + math.exp(-z))


def test_quality_scores_by_definition():
    r = random.Random(8)
    texts = [b"", b"a", b"x" * 255, b"y" * 256, *[bytes(r.randrange(256) for _ in range(r.randrange(2000))) for _ in range(12)]]
    net = quality.fit(texts, np.array([float(len(t) % 2) for t in texts]))
    assert np.allclose(quality.score_texts(net, texts), [naive_score(net, t) for t in texts], atol=1e-4)


def test_quality_gradient():
    """A step of the fit goes down the log loss: the gradients are those of the loss, by small differences."""
    texts, y = [b"good words here " * 40, b"bad ## words && " * 30, b"fine text again " * 50], np.array([1.0, 0.0, 1.0])
    loss = lambda net: -np.mean([math.log(p if t else 1 - p) for p, t in zip(quality.score_texts(net, texts), y)])
    assert loss(quality.fit(texts, y)) < 0.1 < loss(quality.new_network(0.6))


def test_accept_keeps_clashing_columns(spark):
    rows = [(i, "some good words " * 20 if i % 2 else "### &&& " * 30, 0.25, b"b", 7) for i in range(60)] + [(None, None, None, None, None), (1, "some good words " * 20, 0.25, b"b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, bytes binary, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = quality.accept(docs, labels)
    assert kept.schema == docs.schema
    out = kept.where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"] for r in out} == set(range(1, 60, 2)) and len(out) == 31 and all(r["score"] == 0.25 and r["a.b"] == 7 for r in out)
    assert quality.accept(docs.limit(0), labels).count() == 0


def test_long_texts_are_in_the_training_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (200_000 if i % 3 else 10)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sizes = [len(r["text"]) for r in quality.training_rows(docs, labels).collect()]
    assert len(sizes) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30)) and max(sizes) == 200_000
    few = quality.training_rows(docs, labels, train_bytes=500_000).collect()
    assert 3 <= len(few) < len(sizes)


def test_urls(spark):
    r = random.Random(1)
    cases = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.example.com/en/?q", "a://b://c.com/", "http://ä.com/#/en/", "http://com", "http://x.org/" + "9" * 5000]
    cases += [f"http://{r.choice(['a', 'b-c'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr'])}/{i}" for i in range(80)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(cases)] + [(None, cases[4], "h", 1), (1, "http://org/", "h", 1)], "page_id long, url string, html string, suffix int")
    out = urls.judge(pages).collect()
    assert len(out) == len(cases) + 2

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]

    for x in out:
        if x["page_id"] is None or (x["page_id"] == 1 and x["host"]):
            continue
        host, path = parts(cases[x["page_id"]])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (x["host"], x["path"]) == (host, path)
        assert x["rule"] == (max(fits)[1] if fits else None) and x["verdict"] == (max(fits)[2] if fits else "allow" if x["score"] >= 0.5 else "block")


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.uniform(size=(600, len(urls.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    prior, trees = urls.fit(x, y)

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    z = np.array([prior + sum(value(t, row) for t in trees) for row in x])
    assert ((z > 0) == y).mean() > 0.9
    assert urls.fit(x[:0], y[:0])[1] == [] and urls.fit(x[:5], np.ones(5))[1] == []


def url_features(pages):
    """FEATURES of (url, ruled) rows by the docstring's words."""
    hosts, out = [], []
    for u, ruled in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        hosts.append((host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0], ruled))
    by = {}
    for host, _, ruled in hosts:
        by.setdefault(host.rsplit(".", 1)[-1], []).append(ruled)
    for (u, _), (host, path, _) in zip(pages, hosts):
        u = u or ""
        n, query, peers = max(len(u), 1), re.search(r"\?([^#]*)", u), by[host.rsplit(".", 1)[-1]]
        params = query[1].count("&") + 1 if query and query[1] else 0
        entropy = round(-sum(c / n * math.log2(c / n) for c in Counter(u).values()), 9)
        out.append([len(u), path.count("/"), len(re.findall("[0-9]", u)) / n, entropy, params, host.count("-"), host.count(".") + 1, len(path), math.log1p(len(peers)), (peers.count("allow") + 1) / (len(peers) - peers.count(None) + 2)])
    return np.array(out, dtype=float)


def test_url_scores_by_definition(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").union(spark.createDataFrame([(900, None, ""), (901, "x", ""), (902, "http://q.de/a?b&c#?d", "")], "page_id long, url string, html string"))
    urls_of = {r["page_id"]: r["url"] for r in pages.collect()}
    out = {r["page_id"]: r for r in urls.judge(pages).collect()}
    ids = sorted(out)
    verdict = {k: next((v for v, h, p in urls.RULES if h + p == out[k]["rule"]), None) for k in ids}
    x = url_features([(urls_of[k], verdict[k]) for k in ids])
    ruled = [i for i, k in enumerate(ids) if verdict[k]]
    prior, trees = urls.fit(x[ruled], np.array([float(verdict[ids[i]] == "allow") for i in ruled]))

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    assert trees and len(ruled) > 20
    for k, row in zip(ids, x):
        score = 1 / (1 + math.exp(-prior - sum(value(t, row) for t in trees)))
        assert abs(out[k]["score"] - score) < 1e-6
        assert out[k]["verdict"] == (verdict[k] or ("allow" if score >= 0.5 else "block"))


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines(docs):
    rows = pairs(docs)
    places = sorted({(-1 if i is None else i, hash(t), k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))}, key=lambda p: p)
    # the order among texts of one id is by Spark's hash: here ids with two texts share no line with others
    seen, gone = [], {}
    for i, h, k, line in places:
        w = line.split(" ")
        if len(w) < lines.MIN_WORDS:
            continue
        if any(w == v or distance_one(w, v) for v in seen):
            gone.setdefault((i, h), set()).add(k)
        seen.append(w)
    want = Counter()
    for i, t in rows:
        drop = gone.get((-1 if i is None else i, hash(t)), set())
        want[(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop), 0 if t is None else len(t.split("\n")), len(drop))] += 1
    assert sum(map(len, gone.values())) > 20
    out = lines.digest(docs).collect()
    assert Counter((x["doc_id"], x["text"], x["n_lines"], x["n_repeated"]) for x in out) == want and any(x["n_near"] for x in out)
    assert lines.dedup(docs).columns == docs.columns


def test_short_lines_are_repeats_too(spark):
    rows = [(1, "Les.\nto be\n\n \nonetwothree" + "x" * 300), (2, "\nLes.\nto bee\n \nonetwothree" + "x" * 300 + "\na\tb\tc d"), (3, "Les.\nto be\na\tb\tc d")]
    out = lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["text"] for x in out] == [rows[0][1], "\nto bee\n \na\tb\tc d", ""]
    assert [(x["n_lines"], x["n_repeated"], x["n_near"]) for x in out] == [(5, 0, 0), (6, 2, 0), (3, 3, 0)]


def test_licenses(docs):
    by = Counter()
    for i, t in pairs(docs):
        w = words(t)
        found = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        by[(i, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))] += 1
    out = licenses.scan(docs).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in out) == by
    assert all(set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1 for x in out)


def test_licenses_reworded(spark):
    text = "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and the associated documentation files (the Software), to deal in it without restriction"
    x = licenses.scan(spark.createDataFrame([(1, text), (2, "permission is hereby given to any person without restriction")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert x[0]["labels"] == "mit" and x[0]["base_labels"] == "" and 0.5 < x[0]["score"] < 1 and x[1]["labels"] == ""


def test_katz(docs):
    rows = pairs(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        ws = tokens(t)
        want[(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4))] += 1
    model = katz.Model(docs)
    out = katz.score(docs, model).collect()
    assert Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 4)) for x in out) == want
    assert all(x["score"] <= 0 and math.isfinite(x["score"]) for x in out)
    h = model.histories.toPandas()
    assert len(h) and (h["weight"] > 1e-6).all() and np.allclose(h["p"] + h["weight"] * (1 - h["q"]), 1)
    # every score by the formulas
    c2 = Counter(p for i, t in rows if not held(i) for p in zip([1, *tokens(t)], tokens(t)))
    d1, d2 = (katz._discounts(Counter(x.values())) for x in (c, c2))
    q = {w: d1.get(k, 1) * k / n for w, k in c.items()}
    unknown = 1 - sum(q.values())
    after = {}
    for (a, b), k in c2.items():
        after.setdefault(a, {})[b] = k
    p = {(a, b): d2.get(k, 1) * k / (sum(to.values()) + 0.5) for a, to in after.items() for b, k in to.items()}
    weight = {a: (1 - sum(p[a, b] for b in to)) / (1 - sum(q[b] for b in to)) for a, to in after.items()}
    lp = lambda a, b: math.log10(p.get((a, b)) or weight.get(a, 1) * q.get(b, unknown))
    brute = Counter((i, round(sum(lp(a, b) for a, b in zip([1, *tokens(t)], tokens(t))), 4)) for i, t in rows)
    assert model.scale == 1 and any((a, b) not in p for i, t in rows for a, b in zip([1, *tokens(t)], tokens(t)))
    assert Counter((x["doc_id"], round(x["score"], 4)) for x in out) == brute


def test_katz_chunks_and_buckets_do_not_change_scores(docs, monkeypatch):
    kept = lambda: sorted((x["doc_id"] or -1, x["n_known"], round(x["score"], 6)) for x in katz.score(docs).collect())
    one = kept()
    monkeypatch.setattr(katz, "CHUNK", 100)
    monkeypatch.setattr(katz, "BUCKET", 500)
    assert kept() == one


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = pairs(docs)
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    out = Counter((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.digest(docs).collect())
    assert out == Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group))
    kept = simhash.keep_one(docs, 4, 1, 0.0, 4)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_simhash_stage(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = stage_keeps(rows)
    assert len(want) < len(set(rows)) and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


def stage_fingerprints(text):
    """The stage's fingerprints by whole numbers, and the set of shingles."""
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    full, out = (1 << 64) - 1, []
    for k in range(simhash.STAGE_WORDS):
        hs = []
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            if k:
                h = (h + k * 0x9E3779B97F4A7C15) & full
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
                h = (h ^ h >> 27) * 0x94D049BB133111EB & full
                h ^= h >> 31
            hs.append(h)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)))
    return out, set(shingles)


def met(a, b):
    """Whether the stage compares two fingerprints: few bits differ, and in a half the 2-bit segments' counts do by at most 2 in all."""
    count = lambda x, k: (x >> 2 * k & 3).bit_count()
    apart = [abs(count(a, k) - count(b, k)) for k in range(32)]
    return (a ^ b).bit_count() <= simhash.STAGE_BITS and min(sum(apart[:16]), sum(apart[16:])) <= 2


def stage_keeps(rows):
    """Different rows (doc_id, text) that stay, by comparing all pairs of texts; ids with several texts only in groups of their own."""
    prints = {t: stage_fingerprints(t) for _, t in rows}
    texts = list(prints)
    group = {t: k for k, t in enumerate(texts)}
    for x in texts:
        for y in texts:
            (f, s), (g, u) = prints[x], prints[y]
            alike = f[0] == g[0] or any(met(a, b) for a, b in zip(f, g)) and len(s & u) >= 0.8 * len(s | u)
            if alike and group[x] != group[y]:
                old, new = group[x], group[y]
                group = {t: new if k == old else k for t, k in group.items()}
    first = {}
    for i, t in set(rows):
        key = (i is None, i or 0)
        if group[t] not in first or key < first[group[t]][0]:
            first[group[t]] = (key, (i, t))
    return [r for _, r in first.values()]


def test_simhash_cells_find_every_link():
    r = np.random.default_rng(2)
    f = r.integers(-(2**63), 2**63 - 1, 300)
    near = []
    for x in f:
        for d in range(1, 5):
            y = int(np.int64(x).view(np.uint64))
            for b in r.choice(64, d, replace=False):
                y ^= 1 << int(b)
            near.append(np.uint64(y).view(np.int64))
    every = np.unique(np.concatenate([f, np.array(near)]))
    c, v = simhash.cells(every)
    o = np.argsort(c, kind="stable")
    a, b, at = simhash.links_in_cells(c[o], v[o])
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    assert all(set(c[v == x]) & set(c[v == y]) for x, y in zip(a[:50], b[:50])) and (c[o][at] < 2**33).all()
    want = {frozenset((int(x), int(y))) for i, x in enumerate(every) for y in every[:i][np.bitwise_count(every[:i].view(np.uint64) ^ x.view(np.uint64)) <= 4]}
    assert got == want and len(want) > 1000
    assert len(simhash._forest(np.arange(200, dtype=np.int64))) == 199


def test_simhash_stage_radius():
    """Fingerprints of 5 to 10 changed bits: cells give those links that the definition has."""
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(0, 2**63, 300, dtype=np.uint64)]
    far = [x ^ sum(1 << int(k) for k in r.choice(64, 5 + i % 6, replace=False)) for i, x in enumerate(base)]
    every = np.unique(np.array(base + far, np.uint64)).view(np.int64)
    c, v = simhash.cells(every)
    o = np.argsort(c, kind="stable")
    a, b, _ = simhash.links_in_cells(c[o], v[o], simhash.STAGE_BITS)
    got = {frozenset(p) for p in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist())}
    whole = every.view(np.uint64).tolist()
    assert got == {frozenset((x, y)) for i, x in enumerate(whole) for y in whole[:i] if met(x, y)} and len(got) > 50
    both = simhash.links_in_cells(np.zeros(200, np.int64), np.arange(200, dtype=np.int64), simhash.STAGE_BITS)
    assert len(both[0]) == 2 * 199


def test_simhash_stage_leaves_no_similar_pair(spark):
    """Pairs of just 0.8, some of no near fingerprints, and a crowd in common cells: groups are those of all pairs of texts."""
    r = random.Random(3)
    line = lambda n: [r.choice(WORDS) + str(r.randrange(900)) for _ in range(n)]

    def changed(w, places):
        return [f"new{r.randrange(10**6)}" if k in places else x for k, x in enumerate(w)]

    texts = []
    for _ in range(80):
        w = line(94)
        texts += [w, changed(w, {20, 60})]  # 80 of 100 shingles shared
    crowd = line(300)
    for _ in range(60):
        crowd = changed(crowd, {r.randrange(300) for _ in range(r.randrange(1, 9))})
        texts += [crowd, changed(crowd, {r.randrange(300) for _ in range(4)})]
    often = line(7)
    texts += [often + line(n) for n in (1, 1, 2, 2, 30) for _ in range(8)] + [["one"] * n for n in (5, 6, 40)]
    texts = [" ".join(w) for w in texts] + [None, "", "of few words"]
    sets = [stage_fingerprints(t) for t in texts]
    group = list(range(len(texts)))
    for a, (f, s) in enumerate(sets):
        for b, (g, u) in enumerate(sets[:a]):
            if group[a] != group[b] and (f[0] == g[0] or len(s & u) >= 0.8 * len(s | u)):
                group = [group[a] if x == group[b] else x for x in group]
    first = {g: i for i, g in reversed(list(enumerate(group)))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(stage_keeps(list(enumerate(texts)))) > len(first)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(first.values())


def test_simhash_splits_heavy_cells(spark, monkeypatch):
    """Near fingerprints in one heavy cell: blocks find the links that one task finds, and those that all pairs have."""
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 2**62, 3)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), replace=False)) for b in base for _ in range(150)}
    fps = sorted((x + (1 << 63)) % (1 << 64) - (1 << 63) for x in fps)
    df = spark.createDataFrame([(w, x) for w in (0, 3) for x in fps], "word int, fp long")

    def groups():
        label = {(w, x): x for w in (0, 3) for x in fps}
        for w, a, b in simhash.fingerprint_links(df).collect():
            assert (np.int64(a) ^ np.int64(b)).view(np.uint64).item().bit_count() <= 4
            old, new = label[w, a], label[w, b]
            label = {k: new if v == old and k[0] == w else v for k, v in label.items()}
        return {frozenset(k for k, v in label.items() if k[0] == w and v == x) for w in (0, 3) for x in set(label.values())} - {frozenset()}

    one = groups()
    assert len(one) == 6
    monkeypatch.setattr(simhash, "HEAVY", 40)
    monkeypatch.setattr(simhash, "COARSE", 1 << 30)
    assert groups() == one


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 16))
    x[50:60] = x[50]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1001, [float("nan")] * 16, 1), (1002, [None] * 16, 1), (1003, [], 1), (None, rows[3][1], 1), (7, rows[9][1], 1)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and i < 1000]
    hits = total = 0
    for q, v in good:
        if q % 50:
            continue
        s = sorted(((-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in good if i != q))
        s = [(round(a, 9), i) for a, i in s]
        best = sorted({i: a for a, i in reversed(s)}.items(), key=lambda e: (e[1], e[0]))[:5]
        mine = sorted((z for z in out if z["query_id"] == q), key=lambda z: z["rank"])
        assert [z["rank"] for z in mine] == list(range(1, len(mine) + 1))
        hits += len({z["vec_id"] for z in mine} & {i for i, _ in best})
        total += 5
        assert all(abs(z["score"] + dict((i, a) for i, a in best)[z["vec_id"]]) < 1e-6 for z in mine if z["vec_id"] in dict(best))
    assert hits / total >= 0.9


def test_neighbours_split_heavy_buckets(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = 1 + 0.01 * r.standard_normal((300, 8))  # all in few buckets
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = lambda: sorted((z["query_id"], z["rank"], z["vec_id"], z["score"]) for z in neighbours.search(df).collect())
    one = found()
    monkeypatch.setattr(neighbours, "HEAVY", 20)
    assert found() == one and len(one) == 30
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -2
        assert [z[2] for z in one if z[0] == q] == np.argsort(-s)[:5].tolist()


def test_neighbours_count_different_ids_and_find_all(spark):
    e = lambda j, w=1.0: [w if d == j else 0.0 for d in range(64)]
    rows = [(50, e(0)), *[(3, e(0))] * 7, *[(6, [1.0, 0.001 * d, *[0.0] * 62]) for d in range(1, 9)], (4, e(0)), (5, e(0)), (9, e(0, -1.0)), (100, e(7))]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {q: [(x["vec_id"], round(x["score"], 4)) for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q] for q in (50, 100)}
    assert found == {50: [(3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (100, 0.0)], 100: [(3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (9, 0.0)]}


def test_decontaminate(spark, docs, texts):
    items = [(1, texts[30]), (2, texts[7][:200]), (2, texts[7][:200]), (3, "one"), (4, None), (5, ""), (None, texts[9]), (10, "two Three"), (11, texts[40])]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
    grams = set()
    for i, t in items:
        w = words(t)
        k = min(8, len(w))
        grams |= {(i, tuple(w[p : p + k])) for p in range(len(w) - k + 1)} if w and i is not None else set()
    want = Counter()
    for i, t in pairs(docs):
        w, hit, ids = words(t), set(), set()
        for item, g in grams:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    ids.add(str(item))
        want[(i, len(w), len(hit), len(ids), len(ids) >= 2)] += 1
    out = decontaminate.digest(docs, bench).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) for x in out) == want
    duck = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toArrow(), bench.select("item_id", "text").toArrow()
    duck.register("documents", documents)
    duck.register("benchmark", benchmark)
    mine = Counter(tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in out)
    assert mine == Counter(r[1:] for r in duck.sql(decontaminate.ORACLE_SQL).fetchall())
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and decontaminate.digest(left, bench).where("n_items > 1").count() == 0


def test_packing(spark, docs):
    out = packing.packed(docs, 64, keep_ids=True).toPandas()
    assert Counter(out[out["piece"] == 0]["doc_id"].fillna(-1)) == Counter(-1 if i is None else i for i, _ in pairs(docs))
    encode = packing.encoder()
    ids = {i: encode(t or "") + (2).to_bytes(4, "little") for i, t in pairs(docs) if i is not None and i != 3}
    for i, g in out.groupby("doc_id"):
        if i in (3, 12, 20, *range(68, 71)):
            continue
        g = g.sort_values("piece")
        assert b"".join(g["ids"]) == ids[i] and (g["length"].to_numpy()[1:] == 64).all() and g["length"].max() <= 64
        assert all(zlib.crc32(b) == c for b, c in zip(g["ids"], g["ids_crc32"]))
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= 1.05 * -(-out["length"].sum() // 64) + 1


def test_local_search_empties_bins():
    bins = Counter({(6, 3): 2, (5, 1): 1, (4,): 1, (2, 2): 1})  # 32 of 10 a bin: four will do
    after = packing.local_search(bins, 10)
    assert sum(after.values()) == 4 and sorted(x for b, n in after.items() for x in b * n) == sorted(x for b, n in bins.items() for x in b * n)
    assert all(sum(b) <= 10 for b in after)


def test_local_search_serves_all_bins():
    n = 10_000
    bins = Counter({(6, 3): 2 * n, (5, 1): n, (4,): n, (2, 2): n})
    after = packing.local_search(bins, 10)
    assert sum(after.values()) <= 4 * n and all(sum(b) <= 10 and k > 0 for b, k in after.items())
    items = lambda bins: sum((Counter({x: k * b.count(x) for x in set(b)}) for b, k in bins.items()), Counter())
    assert items(after) == items(bins)


def fewest(items, limit):
    """The least number of bins, by dynamic programming over subsets: (bins, fill of the last)."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(items)):
        best[mask] = min((n, f + x) if f + x <= limit else (n + 1, x) for i, x in enumerate(items) if mask >> i & 1 for n, f in [best[mask ^ 1 << i]])
    return best[(1 << len(items)) - 1][0]


def test_search_against_all_packings():
    r, equal, worse = random.Random(3), 0, 0
    for _ in range(60):
        items = [r.randrange(2, 14) for _ in range(10)]
        start = packing.best_fit(Counter(items), 20)
        after = packing.local_search(start, 20)
        assert sorted(x for b, n in after.items() for x in b * n) == sorted(items) and all(sum(b) <= 20 and n > 0 for b, n in after.items())
        least, n = fewest(items, 20), sum(after.values())
        assert least <= n <= sum(start.values())
        equal += n == least
        worse += sum(start.values()) > least
    assert equal >= 58 and worse <= 60


def test_search_empties_what_best_fit_leaves():
    r, fewer = random.Random(9), 0
    for _ in range(30):
        counts = Counter(r.randrange(20, 60) for _ in range(120))
        start = packing.best_fit(counts, 100)
        after = packing.local_search(start, 100)
        assert sum((Counter({x: n * b.count(x) for x in set(b)}) for b, n in after.items()), Counter()) == counts
        fewer += sum(after.values()) < sum(start.values())
    assert fewer > 0


def test_equal_swaps_leave_smaller_items_underfull():
    bins = Counter({(60, 30): 2, (70, 20, 10): 5, (40, 30, 30): 3, (100,): 1})
    out = packing.equal_swaps(bins, 100)
    fills = lambda c: Counter(f for b, n in c.items() for f in [sum(b)] * n)
    weight = lambda c: sum(n * sum(x * x for x in b) for b, n in c.items() if sum(b) < 100)
    assert fills(out) == fills(bins) and weight(out) < weight(bins) and sum(out.values()) == 11


def test_encoder_has_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(), random.Random(5)
    for _ in range(800):
        x = "".join(r.choice([" ", "  ", "\n", " \n", "\u00a0", "a", "The", "é", "'s", "12", "!!", "\t", "我", "word", "<|endoftext|>"]) for _ in range(r.randrange(25)))
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<script>var a='</p>'</script><style>p{}</style>", ""),
        ("<body><nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>T &amp; U</h1><p>one\n  two<b>!</b><p>three &eacute;</article><footer>f</footer>", "T & U\none two!\nthree é"),
        ("<div class='cookie-notice'>ok?</div><div class=ad>buy<div>now</div></div><main><p>the text of the page is here</p><div id='comments'><p>first!</p></div><form>x</form></main><aside>s</aside>", "the text of the page is here"),
        ("<article><p>a<!-- x --> b</p><p></p><pre>c\n d</pre>", "a b\nc d"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_html(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("menu", ["", "<nav><ul>" + "<li><a href='/x'>some menu entry</a></li>" * 12 + "</ul></nav>", "<ul>" + "<li><a href='/x'>some entry</a></li>" * 9 + "</ul>"])
def test_html_density_decides(menu):
    page = f"<body>{menu}<div class=xq>Buy now</div><div>{'<p>' + 'word ' * 50 + '</p>'}{'<p>' + 'more ' * 50 + '</p>'}</div></body>"
    root = html.parse(page)
    html.measure(root)
    assert root.density > 0 and root.peak is not root and root.peak.chars == 400
    assert html.extract(page) == "\n".join([("word " * 50).strip(), ("more " * 50).strip()])


TALK = "The quick brown fox jumps over the lazy dog and runs. " * 4


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout with-sidebar"><article><h1>T</h1><p>{TALK}</p></article><div class="sidebar">{TALK}</div></div>',
        f'<div class="post share"><h1>T</h1><p>{TALK}</p></div>', f'<div id="search-page"><main><h1>T</h1><p>{TALK}</p></main></div>',
        f'<form id="aspnetForm"><div class="menu"><a href=x>a</a></div><div><h1>T</h1><p>{TALK}</p></div><input><button>Go</button></form>',
        f"<ul><li><a href=a>Home page</a></li><li><a href=b>About us</a></li></ul><div><h1>T</h1><p>{TALK * 2}</p></div><div>Copyright 2024 Foo</div>",
        f"<main><h1>T</h1><p>{TALK}</p><div id=comments><p>{TALK}</p><p>{TALK}</p></div></main>",
        f"<div><h1>T</h1><p>{TALK}</p></div><div id=comments>{f'<p>{TALK}</p>' * 4}</div>",
    ],
)
def test_html_names_only_weigh(page):
    assert html.extract(f"<body>{page}</body>").replace(f"{TALK.strip()} {TALK.strip()}", TALK.strip()) == f"T\n{TALK.strip()}"


def test_html_densities_by_definition(spark):
    """Densities of whole pages, recomputed with the standard library's parser; and that they decide."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.nodes, self.raw = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag in html.RAW | {"head"}:
                self.raw += 1
            elif not self.raw and tag in ("div", "nav", "article", "footer", "li", "ul"):
                self.open.append({"tag": tag, "text": 0, "links": 0})
                self.nodes.append(self.open[-1])
            self.link = tag == "a"

        def handle_endtag(self, tag):
            if tag in html.RAW | {"head"}:
                self.raw -= 1
            elif self.open and self.open[-1]["tag"] == tag:
                self.open.pop()
            if tag == "a":
                self.link = False

        def handle_data(self, data):
            n = 0 if self.raw else len("".join(data.split()))
            for x in self.open:
                x["text"] += n
                x["links"] += n * self.link

    changed = 0
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        root, mine, todo = html.parse(row["html"].replace("&", "")), [], []
        html.measure(root)
        todo = [root]
        while todo:
            x = todo.pop()
            if x.tag in ("div", "nav", "article", "footer", "li", "ul"):
                mine.append((x.tag, x.chars, x.link_chars))
            inside = [c for c in x.children if isinstance(c, html.Node)]
            if x.chars:
                ratio = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
                base = x.chars * x.link_chars / max(1, x.chars - x.link_chars) + root.link_chars / root.chars * x.chars + math.e
                plain = x.chars / max(1, x.tags) * math.log(max(1.0, ratio)) / math.log(math.log(base))
                marks = [p for p in ups(x) if p.noise]
                assert math.isclose(x.density, plain * html.WEIGHT ** len(marks), abs_tol=1e-9)
            todo += inside
        tree = Tree()
        tree.feed(row["html"].replace("&", ""))
        assert sorted(mine) == sorted((x["tag"], x["text"], x["links"]) for x in tree.nodes)
        changed += root.peak is not root
    assert changed > 45  # very short articles have less than their pages


def ups(node):
    while node is not None:
        yield node
        node = node.parent


def test_html_keeps_all_dense_subtrees():
    parts = [f"<p>{w * 40}</p>" for w in ("one ", "two ", "six ", "ten ")]
    page = f"<div><div>{''.join(parts[:3])}</div><div>{parts[3]}{parts[0]}</div></div><div class=links><a href=x>go on</a></div>"
    assert html.extract(page).split("\n") == [("one " * 40).strip(), ("two " * 40).strip(), ("six " * 40).strip(), ("ten " * 40).strip(), ("one " * 40).strip()]


def test_pages(spark):
    rows = [(1, "u", "<article><p>a</p></article>", 5), (1, "u", "<article><p>a</p></article>", 5), (None, None, None, 5)]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((x["text"], x["n_chars"]) for x in out) == [("", 0), ("a", 1), ("a", 1)]


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, f in p.STAGES[:-1]:
        assert f(spark, docs, d).columns == docs.columns
    out = p.run(spark, d).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 1024


def test_links_of_a_dense_group_are_compared_in_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [" ".join([*(f"w{i}" for i in range(60)), f"x{k}"]) for k in range(16)] + [" ".join(f"y{k}{i}" for i in range(60)) for k in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    firsts = docs.select(F.col("doc_id").alias("fp"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("th")).alias("first"))
    pairs = [(a, b, a, b) for b in range(18) for a in range(b)]
    links = simhash.materialize(spark.createDataFrame(pairs, "a long, b long, la long, lb long"), "pairs")
    compared, written = [], simhash.materialize

    def counted(df, name):
        out = written(df, name)
        if name == "taken-links":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    found = [(r["a"], r["b"]) for r in simhash.similar(docs, links, firsts, 5, 0.8).collect()]
    group = {0}
    for _ in found:
        group |= {x for link in found if group & set(link) for x in link}
    assert group == set(range(16)) and all(a < 16 and b < 16 for a, b in found)
    assert compared and max(compared) <= 18 < len(pairs)  # no round moves more sets than there are ends
