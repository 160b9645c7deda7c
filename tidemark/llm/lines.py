"""Line dedup through the deletion neighbourhood.

The unit of an edit is a word (lines split at single spaces). Two lines of at least MIN_WORDS words are near if one
word inserted, deleted or replaced makes them equal: one edit in five words is a similarity of 0.8. A line occurrence
goes if the same line, or a line near to it, occurs earlier in the corpus; earlier is by (doc_id, hash of the
document's text, line number), null ids first. So the earliest of each stays. Lines of fewer words go only as exact
repeats; blank lines (white space alone) are no content and always stay.

Near lines agree exactly in their first or in their last half, so a line emits deletion variants only if it shares a
half with another line, and only for places in the other half: nothing near is lost. Equal variants are grouped, never
paired: each line is compared with the earliest line of its groups, and every group member is within the bound of
that one. The words of both lines are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, discard, fresh, materialize, small_side

MIN_WORDS = 5
_MASK = (1 << 40) - 1


def _g(word: Column, i: Column, salt: int) -> Column:
    """A word's hash at a place; sums of these are a line's hash."""
    return F.xxhash64(word, i.cast("int"), F.lit(salt)).bitwiseAND(F.lit(_MASK))


def _total(words: Column, shift: int, salt: int) -> Column:
    return F.aggregate(F.transform(words, lambda w, i: _g(w, i - shift, salt)), F.lit(0).cast("long"), lambda a, x: a + x)


def _without(words: Column, i: Column) -> Column:
    return F.when(i < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, drop) of the documents that lose lines; drop has twice each line's number, plus 1 for near ones."""
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    each = each.select("*", n.cast("int").alias("n")).where(F.col("line").rlike(r"\S"))
    m = [F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")]
    halves = [F.xxhash64(F.lit(k), m[j], F.call_function("substring_index", F.col("line"), F.lit(" "), -m[j] if k else m[j])).alias(f"h{k}{j}") for k in (0, 1) for j in (0, 1)]
    lines = materialize(each.select("doc_id", "th", "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), "n", *halves), "lines")

    place, names = F.struct("doc_id", "th", "pos"), ["h00", "h01", "h10", "h11"]
    distinct = materialize(lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c"), F.max("n").alias("n"), *[F.max(h).alias(h) for h in names]), "distinct-lines")
    keys = distinct.where(F.col("n") >= min_words).select("a", "b", F.inline(F.array_distinct(F.array(*[F.struct(F.lit(h[1]).alias("kind"), F.col(h).alias("k")) for h in names]))))
    shared = keys.groupBy("kind", "k").agg(F.count("*").alias("c")).where("c > 1").select("kind", "k")
    halved = materialize(keys.join(shared, ["kind", "k"], "left_semi").groupBy("a", "b").agg(F.max(F.col("kind") == "0").alias("pre"), F.max(F.col("kind") == "1").alias("suf")), "halved-lines")

    # the words of the lines that share a half, taken from the document where each occurs first
    wanted = distinct.drop("n").join(small_side(halved), ["a", "b"]).select(F.col("first.doc_id").alias("d"), F.col("first.th").alias("h"), F.struct("a", "b", "pre", "suf", F.col("first.pos").alias("pos")).alias("x"))
    wanted = materialize(wanted.groupBy("d", "h").agg(F.collect_list("x").alias("xs")), "wanted")
    held = wanted.agg(F.count("*") * ROW_BYTES + F.coalesce(F.sum(F.size("xs")), F.lit(0)) * 64).first()[0]
    asked = F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    got = texts.join(asked, texts["doc_id"].eqNullSafe(asked["d"]) & (texts["h"] == asked["h"])).select("doc_id", texts["h"].alias("th"), "xs", F.split("text", "\n").alias("ls"))
    line = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["pre"].alias("pre"), x["suf"].alias("suf"), F.struct("doc_id", "th", x["pos"].alias("pos")).alias("first"), F.split(F.get("ls", x["pos"]), " ").alias("w"))
    got = got.select(F.inline(F.transform("xs", line)))
    cand = got.dropDuplicates(["a", "b"]).select("*", F.size("w").alias("n"), *[_total(F.col("w"), 1 - whole, salt).alias(f"{'tf'[whole]}{salt}") for whole in (0, 1) for salt in (0, 1)])
    cand = materialize(cand, "near-lines")

    # deletion variants: the hash of a line without word i, from running sums
    run = W.partitionBy("a", "b").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    v = cand.select("a", "b", "n", "pre", "suf", "t0", "t1", F.posexplode("w").alias("i", "x"))
    variant = [F.col(f"t{s}") - _g(F.col("x"), F.col("i") - 1, s) + F.coalesce(F.sum(_g(F.col("x"), F.col("i"), s) - _g(F.col("x"), F.col("i") - 1, s)).over(run), F.lit(0)) for s in (0, 1)]
    half = F.floor((F.col("n") - 1) / 2)
    v = v.select("a", "b", "n", "i", "pre", "suf", variant[0].alias("v0"), variant[1].alias("v1")).where(F.col("pre") & (F.col("i") >= half) | F.col("suf") & (F.col("i") < F.col("n") - half))
    keyed = v.select("a", "b", "i", F.inline(F.array(
        F.struct(F.lit("s").alias("role"), F.xxhash64(F.lit("s"), "n", "i", "v0", "v1").alias("key")),
        F.struct(F.lit("y").alias("role"), F.xxhash64(F.lit("d"), F.col("n") - 1, F.lit(0), "v0", "v1").alias("key")),
    )))
    whole = cand.select("a", "b", F.lit(-1).alias("i"), F.lit("x").alias("role"), F.xxhash64(F.lit("d"), "n", F.lit(0), "f0", "f1").alias("key"))
    variants = materialize(keyed.unionByName(whole), "variants")
    many = variants.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("role") != "y").alias("ok")).where("c > 1 AND ok").select("key")
    where = cand.select("a", "b", "first")
    members = variants.join(many, "key", "left_semi").join(where, ["a", "b"]).withColumn("me", F.struct("first", "i", "a", "b"))
    least = members.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("me"))).alias(f"min_{r}") for r in "sxy"])
    other = F.when(F.col("role") == "s", F.col("min_s")).when(F.col("role") == "x", F.col("min_y")).otherwise(F.col("min_x"))
    pairs = members.join(least, "key").withColumn("o", other).where(F.col("o.first") < F.col("first")).select("a", "b", "i", F.col("o.a").alias("oa"), F.col("o.b").alias("ob"), F.col("o.i").alias("oi"))
    left, right = cand.select("a", "b", "w"), cand.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("w").alias("ow"))
    near = materialize(pairs.join(left, ["a", "b"]).join(right, ["oa", "ob"]).where(_without(F.col("w"), F.col("i")) == _without(F.col("ow"), F.col("oi"))).select("a", "b").distinct().withColumn("near", F.lit(True)), "near")

    judged = distinct.select("a", "b", "first", "c").join(small_side(near), ["a", "b"], "left").where((F.col("c") > 1) | F.col("near")).select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("a", "b", "doc_id", "th", "pos").join(judged, ["a", "b"]).where(F.col("near") | ~place.eqNullSafe(F.col("first")))
    # repeated document rows hold the same places, so a set
    out = materialize(gone.groupBy("doc_id", F.col("th").alias("text_hash")).agg(F.collect_set((2 * F.col("pos") + F.col("near").cast("int")).cast("int")).alias("drop")), "dropped-lines")
    discard(lines, distinct, halved, wanted, cand, variants, near)
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text; with counts, also n_lines, n_repeated, n_near.

    Every row stays, also one whose text becomes empty. Null texts stay null and have no lines; an empty text has one
    empty line. Repeated rows (same id and text) are one document: they lose the same lines. Other columns are left.
    """
    found = repeated_lines(docs, min_words)
    lost = found.agg(F.count("*") * ROW_BYTES + F.coalesce(F.sum(F.size("drop")), F.lit(0)) * 4).first()[0]
    d, h, lost_lines = fresh(docs, "other_id", "other_hash", "lost")
    drop = (F.broadcast(found) if lost <= BROADCAST_BYTES else found).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("drop").alias(lost_lines))
    joined = docs.join(drop, docs["doc_id"].eqNullSafe(drop[d]) & (F.xxhash64(docs["text"]) == drop[h]), "left")
    whole, gone_lines = drop[h].isNull(), drop[lost_lines]
    ls, at = F.split(docs["text"], "\n"), F.transform(gone_lines, lambda x: F.shiftright(x, 1))
    left = F.array_join(F.filter(ls, lambda _, i: ~F.array_contains(at, i)), "\n")
    out = {c: docs[f"`{c}`"] for c in docs.columns} | {"text": F.when(whole, docs["text"]).otherwise(left)}
    if counts:
        near = F.size(F.filter(gone_lines, lambda x: x % 2 == 1))
        gone = F.coalesce(F.size(gone_lines), F.lit(0))
        out |= {"n_lines": F.when(docs["text"].isNull(), 0).otherwise(F.size(ls)).cast("long"), "n_repeated": F.when(whole, 0).otherwise(gone).cast("long"), "n_near": F.when(whole, 0).otherwise(near).cast("long")}
    return joined.select(*[v.alias(c) for c, v in out.items()])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_repeated (lines that go), n_near (of these, for an earlier near line), text."""
    return dedup(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_repeated", "n_near", "text")


#: Near lines by the definition: equal after a word is taken out of both at one place, or out of one of them.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT * FROM (SELECT r, doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM d) ),
c AS (SELECT *, doc_id * 1000000 + pos AS here FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
f AS (SELECT line, min(here) AS spot, string_split(line, ' ') AS w FROM c GROUP BY line),
w AS (SELECT *, len(w) AS n FROM f WHERE len(w) >= {MIN_WORDS}),
v AS (SELECT line, spot, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM w)),
near AS (
  SELECT line FROM (SELECT line, spot, min(spot) OVER (PARTITION BY n, i, x) AS least FROM v) WHERE least < spot
  UNION SELECT v.line FROM v JOIN w ON v.x = w.line AND w.spot < v.spot
  UNION SELECT w.line FROM w JOIN v ON v.x = w.line AND v.spot < w.spot
),
j AS (SELECT c.r, c.pos, near.line IS NOT NULL AS near, near.line IS NOT NULL OR c.here <> f.spot AS lost FROM c JOIN f USING (line) LEFT JOIN near USING (line)),
k AS (SELECT l.r, count(*) AS n_lines, count(*) FILTER (lost) AS n_repeated, count(*) FILTER (near) AS n_near,
             string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (lost IS NULL OR NOT lost) AS text
      FROM l LEFT JOIN j USING (r, pos) GROUP BY l.r)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_repeated, 0) AS BIGINT) AS n_repeated, CAST(coalesce(k.n_near, 0) AS BIGINT) AS n_near,
       CASE WHEN k.n_repeated > 0 THEN coalesce(k.text, '') ELSE d.text END AS text
FROM d LEFT JOIN k USING (r)
"""
