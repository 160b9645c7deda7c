"""Benchmark decontamination: a broadcast set of item n-grams against every document window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES as SMALL_BYTES
from .common import GAP, ROW_BYTES, Sieve, ascii_lower, fresh, materialize, raw_words, words_of

#: Bytes of distinct windows up to which they are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows (s, l) with the ids of their items as text. Items of fewer than n words are one window."""
    w = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    every = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, size)))
    return w.select("item", size.alias("l"), F.explode(every).alias("s")).groupBy("s", "l").agg(F.sort_array(F.collect_set("item")).alias("items"))


def scan(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, spans (merged [start, end) of hit words), items (ids as text, sorted).

    A window is n consecutive words of an item; an item of fewer words is one window; items without words or
    id have none. Null and empty texts have no words. Repeated document rows each get their row, repeated item
    ids count once. Extra columns of either table are not read.
    The windows' strings are compared, so a hit is a true equality, not a hash match.
    """
    grams = materialize(item_windows(items, n), "windows")
    size, sizes = grams.agg(F.sum(F.length("s") + 16 * F.size("items") + 32), F.sort_array(F.collect_set("l"))).first()
    # most places are sieved out by their first word or first words, within the row that holds the document's words
    lead = min([3, *sizes])
    first = Sieve(grams.select(F.array(F.split("s", " ")[0]).alias("words")))
    leads = Sieve(grams.select(F.slice(F.split("s", " "), 1, lead).alias("words")))
    # each document has one marker row, which the marker window keeps; so one pass finds hits and counts words
    marker = docs.sparkSession.createDataFrame([("", 0, [])], grams.schema)
    keyed = grams.union(marker)
    if (size or 0) <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), raw_words(F.col("text")).alias("w"))
    w = F.col("w")
    sieved = F.array_remove(F.transform(w, lambda x, i: F.when(first.passes(x) & leads.passes(x, *[F.get(w, i + k) for k in range(1, lead)]), i).otherwise(F.lit(-1))), -1)
    whole = lambda i: [F.struct(i.alias("p"), F.lit(k).alias("l"), ascii_lower(F.concat_ws(" ", F.slice(w, i + 1, k))).alias("s")) for k in sizes]
    mark = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("l"), F.lit("").alias("s")))
    places = base.select("row", "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", sieved.alias("at"))
    each = places.select("row", "doc_id", "text_hash", "n_words", F.inline(F.concat(mark, F.flatten(F.transform("at", lambda i: F.array(*whole(i)))) if sizes else mark)))
    hits = each.join(keyed, ["s", "l"])
    found = hits.groupBy("row", "doc_id", "text_hash", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("l") > 0, F.struct("p", (F.col("p") + F.col("l")).alias("e"))))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<p:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["p"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["p"].alias("p"), x["e"].alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return found.select("doc_id", "text_hash", "n_words", merged.alias("spans"), F.sort_array("items").alias("items"))


def remove(docs: DataFrame, items: DataFrame, n: int = 8, min_items: int = 2) -> DataFrame:
    """The documents without benchmark text; columns as docs has them.

    Documents with windows of min_items or more items go; of those with fewer, the hit words and the separators
    after them go. Documents without hits are left as they are. Repeated rows are treated alike.
    """
    d, h, spans, of = fresh(docs, "other_id", "other_hash", "spans", "n_items")
    found = scan(docs, items, n).where(F.size("spans") > 0).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("spans").alias(spans), F.size("items").alias(of)).dropDuplicates([d, h])
    found = materialize(found, "contaminated")
    bytes_ = found.agg(F.count("*") * ROW_BYTES + F.coalesce(F.sum(F.size(spans)), F.lit(0)) * 32).first()[0]
    found = F.broadcast(found) if bytes_ <= SMALL_BYTES else found
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[d]) & (F.xxhash64(docs["text"]) == found[h]), "left")
    units = F.regexp_extract_all(F.col("text"), F.lit(f"{GAP.replace('[', '[^', 1)}+{GAP}*"), F.lit(0))
    lead = F.regexp_extract(F.col("text"), f"^{GAP}*", 0)
    left = F.concat(lead, F.array_join(F.filter(units, lambda u, i: ~F.exists(F.col(spans), lambda s: (i >= s["p"]) & (i < s["e"]))), ""))
    kept = joined.where(F.coalesce(F.col(of), F.lit(0)) < min_items)
    out = {c: docs[f"`{c}`"] for c in docs.columns} | {"text": F.when(F.col(of).isNull(), docs["text"]).otherwise(left)}
    return kept.select(*[v.alias(c) for c, v in out.items()])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["e"] - s["p"])
    return scan(docs, items).select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
g AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[p:p + least(len(w), 8) - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS p FROM i WHERE len(w) > 0 AND item_id IS NOT NULL)),
k AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
      FROM (SELECT d.*, k.n, unnest(range(1, len(w) - k.n + 2)) AS p FROM d, k WHERE len(w) >= k.n)),
m AS (SELECT x.r, x.p, x.n, g.item_id FROM x JOIN g ON x.s = g.s AND x.n = g.n),
h AS (SELECT r, count(DISTINCT q) AS c FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS c, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.c, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.c, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
