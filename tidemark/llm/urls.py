"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path): the rules of the query's contract, fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "path_length", "suffix_count", "suffix_allow")
#: The trees are fitted on at most this many of the rows that a rule labels, those of the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 32, 0.3, 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(host: Column, path: Column, rules, value) -> Column:
    """The value of the longest rule that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return out.otherwise(F.lit(None).cast("string"))


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled and the features of FEATURES.

    The two suffix statistics hold the log count of the host's last label over all pages and the smoothed share of
    allowed among its ruled pages. They come from one aggregation with a row for each suffix, joined back; Spark
    broadcasts it when its measured size is small, and splits skewed partitions otherwise.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    p = p.withColumn("rule", _ruled(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[1] + r[2]))).withColumn("ruled", _ruled(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[0])))
    p = p.withColumn("suffix", F.substring_index("host", ".", -1))
    stats = p.groupBy("suffix").agg(
        F.log1p(F.count("*").cast("double")).alias("suffix_count"),
        ((F.count_if(F.col("ruled") == "allow") + 1) / (F.count("ruled") + 2)).alias("suffix_allow"),
    )
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.split(u, "")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    p = p.select(
        "*", F.length(u).cast("double").alias("length"), _count(F.col("path"), "/").cast("double").alias("depth"),
        (F.regexp_count(u, F.lit("[0-9]")) / n).alias("digit_ratio"), F.round(entropy, 9).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0).alias("n_params"),
        _count(F.col("host"), "-").cast("double").alias("n_hyphens"), (_count(F.col("host"), ".") + 1.0).alias("n_labels"),
        F.length("path").cast("double").alias("path_length"),
    )
    return p.join(stats, "suffix")


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Boosted trees for the log odds of y: (prior, trees); a tree is (feature, threshold, left, right) or a value.

    Left is x <= threshold. Without rows the prior is 0, with one class it is that class's smoothed log odds.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return prior, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAST:
            for f, c in enumerate(cuts):
                b = binned[rows, f]
                gs, hs, ns = (np.bincount(b, v, len(c) + 1).cumsum()[:-1] for v in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return RATE * float(total_g / (total_h + 1))
        _, f, k = best
        side = binned[rows, f] <= k
        return (f, float(cuts[f][k]), grow(rows[side], g, h, depth - 1), grow(rows[~side], g, h, depth - 1))

    def value(tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))

    z, trees = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
        z = z + value(trees[-1], x)
    return prior, trees


def _column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], _column(tree[2])).otherwise(_column(tree[3]))


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, score.

    A ruled url has its rule's verdict. The others are allowed if the trees, fitted on ruled urls, give allow at least
    half the probability (score, which all rows have). Null urls and those without :// have an empty host and path.
    Without any ruled url everything else is allowed. Repeated rows each get a row; extra columns are not read.
    """
    f = lexical(pages, rules)
    sample = f.where("ruled IS NOT NULL").select((F.col("ruled") == "allow").cast("double").alias("y"), *FEATURES, F.xxhash64("page_id", "url").alias("h")).orderBy("h", *FEATURES).limit(train_rows).drop("h").collect()
    rows = np.array(sample, dtype=float).reshape(-1, 1 + len(FEATURES))
    prior, trees = fit(rows[:, 1:], rows[:, 0])
    odds = F.lit(prior)
    for t in trees:
        odds = odds + _column(t)
    score = 1 / (1 + F.exp(-odds))
    out = f.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
