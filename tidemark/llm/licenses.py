"""License scan by diagonal voting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Sieve, ascii_lower, raw_words

#: Base phrases and their labels (fixed values of the query's contract).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer notices whose reworded forms the voting finds too: publicly known opening sentences of licenses.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
K = 2
#: Share of a template's k-grams that a merged run of diagonals must hold, and how far apart diagonals may lie to be merged.
COVERAGE, GAP = 0.75, 2


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every word bigram's hash is joined to the template positions (a constant table of a few hundred rows); the
    joined text must be equal too. Votes are summed by document, template and diagonal. A phrase stands where a
    diagonal has all its votes. For templates, diagonals within GAP words merge, and the run counts if it covers
    enough different k-grams and isn't much longer than the template. score: 1 with a base phrase, else the best coverage found.
    Null and empty texts have no words, hence nothing found: labels "", first_word null, score 0.
    Repeated rows each get a row; extra columns are not read.
    """
    spark = docs.sparkSession
    rows, about = [("", -1, 0)], []
    for t, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        w = text.split()
        about.append((t, label, len(w) - K + 1, t < len(phrases)))
        rows += [(" ".join(w[p : p + K]), t, p) for p in range(len(w) - K + 1)]
    at = F.broadcast(spark.createDataFrame(rows, "gram string, t int, tp int").withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "tgram"))
    about_df = F.broadcast(spark.createDataFrame(about, "t int, label string, need int, phrase boolean"))

    keys = spark.createDataFrame([(g.split(),) for g, _, _ in rows[1:]], "words array<string>")
    first, both = Sieve(keys.select(F.slice("words", 1, 1).alias("words"))), Sieve(keys)
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), raw_words(F.col("text")).alias("w"))
    w = F.col("w")
    sieved = F.array_remove(F.transform(w, lambda x, i: F.when(first.passes(x) & both.passes(x, F.get(w, i + 1)), i).otherwise(F.lit(-1))), -1)
    places = base.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", sieved.alias("at"))
    grams = F.transform("at", lambda i: F.struct(i.alias("p"), ascii_lower(F.concat_ws(" ", F.slice(w, i + 1, K))).alias("gram")))
    # a marker keeps one row for each document, so that one pass is enough
    mark = F.array(F.struct(F.lit(-1).alias("p"), F.lit("").alias("gram")))
    each = places.select("row", "doc_id", "n_words", F.inline(F.concat(mark, grams)))
    votes = each.withColumn("h", F.xxhash64("gram")).join(at, "h").where((F.col("gram") == F.col("tgram")) & ((F.col("p") == -1) == (F.col("t") == -1)))
    diag = votes.groupBy("row", "doc_id", "n_words", "t", (F.col("p") - F.col("tp")).alias("diag")).agg(F.count("*").alias("votes"), F.collect_set("tp").alias("tps"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    # neighbouring diagonals of a document and template form a run
    near = W.partitionBy("row", "t").orderBy("diag")
    runs = diag.withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(near) > GAP).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(near))
    run = runs.join(about_df, "t", "left").groupBy("row", "doc_id", "n_words", "t", "label", "need", "phrase", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tps")))).alias("seen"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count_if(F.col("votes") == F.col("need")).alias("full"),
        F.min(F.when(F.col("votes") == F.col("need"), F.col("diag"))).alias("first"),
        F.max(F.when(F.col("votes") == F.col("need"), F.col("diag"))).alias("last"),
    )
    is_base, share = F.col("phrase") & (F.col("full") > 0), F.col("seen") / F.col("need")
    # verified: enough of the template, or a complete diagonal, in a run that is not mostly other words
    ok = ~F.col("phrase") & ((F.col("full") > 0) | (share >= coverage) & (F.col("hi") - F.col("lo") + 1 <= 2 * F.col("need")))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    found = run.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(is_base, F.col("full"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).cast("long").alias("last_word"),
        text(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"),
        text(F.collect_set(F.when(is_base | ok, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(ok, share)), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")


def _oracle() -> str:
    grams, about = [], []
    for t, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        w = text.split()
        about.append(f"({t}, '{label}', {len(w) - 1}, {t < len(PHRASES)})")
        grams += [f"('{w[p]} {w[p + 1]}', {t}, {p})" for p in range(len(w) - 1)]
    return rf"""
WITH g(gram, t, tp) AS (VALUES {", ".join(grams)}),
a(t, label, need, phrase) AS (VALUES {", ".join(about)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT r, p, w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT *, unnest(range(len(w) - 1)) AS p FROM d)),
v AS (SELECT r, t, p - tp AS diag, p, tp FROM b JOIN g USING (gram)),
x AS (SELECT r, t, diag, count(*) AS votes FROM v GROUP BY r, t, diag),
y AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diag) AS run
      FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag) <= {GAP} THEN 0 ELSE 1 END AS new FROM x)),
z AS (SELECT y.r, y.t, y.run, count(DISTINCT v.tp) AS seen, min(v.p) AS lo, max(v.p) AS hi FROM y JOIN v USING (r, t, diag) GROUP BY y.r, y.t, y.run),
u AS (SELECT y.r, y.t, y.run, label, need, phrase, count(*) FILTER (votes = need) AS n_full, min(diag) FILTER (votes = need) AS first, max(diag) FILTER (votes = need) AS last
      FROM y JOIN a USING (t) GROUP BY y.r, y.t, y.run, label, need, phrase),
o AS (SELECT u.*, phrase AND n_full > 0 AS base, CAST(seen AS DOUBLE) / need AS share,
             NOT phrase AND (n_full > 0 OR CAST(seen AS DOUBLE) / need >= {COVERAGE} AND hi - lo + 1 <= 2 * need) AS ok FROM u JOIN z USING (r, t, run)),
s AS (SELECT r, sum(n_full) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR ok) AS labels,
             max(CASE WHEN base THEN 1.0::DOUBLE WHEN ok THEN share END) AS score FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN s USING (r)
"""


#: The votes by whole strings, without hashes or sieves.
ORACLE_SQL = _oracle()
