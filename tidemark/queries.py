"""Registered queries of the SQL dialect and of the key-value operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import bloom
from .session import Session
from .sources import kv
from .sources.tables import TableError
from .sql.diagnostics import Diagnostic
from .sql.lexer import Lexer, Lookahead

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FLAGSHIP = """
SELECT n.n_name, COUNT(*) AS order_count, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE r.r_name = 'ASIA' AND o.o_orderdate BETWEEN '1995-01-01' AND '1996-12-31'
GROUP BY n.n_name
HAVING COUNT(*) > 10
ORDER BY revenue DESC, n.n_name
LIMIT 10
"""

SELECTS = {
    "scan_alias": "SELECT s.s_name AS nm FROM supplier AS s",
    "select_no_from": "SELECT 1 + 2 AS a, 'x' AS b",
    "comma_join": "SELECT n.n_name AS nn, r.r_name AS rn FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "paren_join": "SELECT n.n_name AS nn, r.r_name AS rn FROM (nation n JOIN region r ON n.n_regionkey = r.r_regionkey)",
    "project_expr": "SELECT l_orderkey AS k, l_quantity * 2 AS q2 FROM lineitem",
    "select_star": "SELECT * FROM nation",
    "qualified_star": "SELECT n.*, r.r_name AS rn FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "bool_projection": "SELECT o_orderkey AS k, o_totalprice > 100000 AS big FROM orders",
    "select_distinct": "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders",
    "filter_where": "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < '1997-01-01'",
    "filter_compare": "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_retailprice < 1500.",
    "filter_like": "SELECT p_partkey AS k FROM part WHERE p_type LIKE 'ECO%' AND p_name NOT LIKE '%widget'",
    "filter_null": "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL",
    "filter_in": "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (1, 2, 1 + 2) AND c_mktsegment NOT IN ('FURNITURE')",
    "filter_between": "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 5 AND 15 AND p_partkey NOT BETWEEN 10 AND 20",
    "filter_bool": "SELECT o_orderkey AS k FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_custkey > 10",
    "filter_truthy": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey",
    "join_inner": "SELECT o.o_orderkey AS k, c.c_name AS cn FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey AS k, o.o_orderkey AS ok FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "join_right": "SELECT l.doc_id AS lk, d.doc_id AS dk FROM labels l RIGHT OUTER JOIN documents d ON l.doc_id = d.doc_id",
    "join_full": "SELECT s.s_suppkey AS sk, c.c_custkey AS ck FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0",
    "join_cross": "SELECT n.n_name AS nn, r.r_name AS rn FROM nation n CROSS JOIN region r",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey",
    "join_chain": "SELECT s.s_name AS sn, n.n_name AS nn, r.r_name AS rn FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "group_by": "SELECT event_type, user_id, COUNT(*) AS c FROM events GROUP BY event_type, user_id",
    "group_having": "SELECT c_nationkey AS nk, COUNT(*) AS c FROM customer GROUP BY c_nationkey HAVING MAX(c_acctbal) > 9000",
    "having_global": "SELECT COUNT(*) AS c FROM orders HAVING COUNT(*) > 10",
    "agg_global": "SELECT COUNT(quality) AS c, MIN(doc_id) AS mn, MAX(doc_id) AS mx, AVG(quality) AS av FROM labels",
    "agg_count_star": "SELECT COUNT(*) AS c FROM lineitem",
    "agg_count_distinct": "SELECT COUNT(DISTINCT l_suppkey) AS c FROM lineitem",
    "agg_sum": "SELECT l_returnflag AS f, SUM(l_linenumber) AS s, SUM(DISTINCT l_linenumber) AS sd FROM lineitem GROUP BY l_returnflag",
    "agg_sum_bool": "SELECT SUM(o_totalprice > 100000) AS s FROM orders",
    "order_by": "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC",
    "order_by_expr": "SELECT c_nationkey AS nk FROM customer GROUP BY c_nationkey HAVING SUM(c_acctbal) > 0 ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5",
    "limit": "SELECT s_suppkey AS k FROM supplier ORDER BY s_suppkey LIMIT 7",
    "limit_offset": "SELECT s_suppkey AS k FROM supplier ORDER BY s_suppkey DESC LIMIT 7 OFFSET 3",
    "top_k": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "arith": "SELECT l_orderkey AS k, (l_linenumber + 3) * 2 - l_linenumber / 2 AS v, l_linenumber % 3 AS m FROM lineitem",
    "arith_unary": "SELECT n_nationkey AS k, -n_nationkey AS a, +n_nationkey AS b, - -n_nationkey AS c FROM nation",
    "literals": "SELECT 42 AS i, 3.14 AS f, 1.5E6 AS e, 'it''s' AS s, TRUE AS t, NULL IS NULL AS n",
}

_AS_SQL = {
    "filter_truthy": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 0",
    "agg_sum": "SELECT l_returnflag AS f, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS sd FROM lineitem GROUP BY l_returnflag",
    "agg_sum_bool": "SELECT CAST(SUM(CAST(o_totalprice > 100000 AS INT)) AS BIGINT) AS s FROM orders",
}

_MAKE = "CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(40) NOT NULL, region INT);"
_FILL = "INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation;"
_BASE = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"

#: Programs on a scratch table, each ending in a SELECT, with SQL of the same effect.
PROGRAMS = {
    "create_insert_select": (_MAKE + _FILL + "SELECT * FROM t", _BASE),
    "insert_select": (_MAKE + "INSERT INTO t (region, name, id) SELECT n_regionkey, n_name, n_nationkey FROM nation WHERE n_nationkey < 9; SELECT * FROM t", _BASE + " WHERE n_nationkey < 9"),
    "insert_values": (_MAKE + _FILL + "INSERT INTO t VALUES (100, 'x', 1 + 1), (101, 'it''s', NULL); SELECT * FROM t", _BASE + " UNION ALL SELECT 100, 'x', 2 UNION ALL SELECT 101, 'it''s', NULL"),
    "insert_defaults": (
        "CREATE TABLE t (id INT, n INT DEFAULT -7, b BOOLEAN DEFAULT TRUE, s TEXT DEFAULT 'none', at TIMESTAMP DEFAULT '2024-01-01');"
        "INSERT INTO t (id) SELECT n_nationkey FROM nation; SELECT * FROM t",
        "SELECT n_nationkey AS id, -7 AS n, TRUE AS b, 'none' AS s, TIMESTAMP '2024-01-01' AS at FROM nation",
    ),
    "update_where": (
        _MAKE + _FILL + "UPDATE t SET region = id, id = region + 1000 * id WHERE region = 2 OR name LIKE 'A%'; SELECT * FROM t",
        "SELECT CAST(CASE WHEN h THEN region + 1000 * id ELSE id END AS INT) AS id, name, CASE WHEN h THEN id ELSE region END AS region FROM (SELECT *, region = 2 OR name LIKE 'A%' AS h FROM (" + _BASE + "))",
    ),
    "delete_where": (_MAKE + _FILL + "DELETE FROM t WHERE region IN (0, 3) AND id > 4; SELECT * FROM t", _BASE + " WHERE NOT (n_regionkey IN (0, 3) AND n_nationkey > 4)"),
    "alter_add": (_MAKE + _FILL + "ALTER TABLE t ADD email TEXT DEFAULT 'a@b'; SELECT * FROM t", "SELECT *, 'a@b' AS email FROM (" + _BASE + ")"),
    "alter_modify": (_MAKE + _FILL + "ALTER TABLE t MODIFY COLUMN region BIGINT; SELECT * FROM t", "SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"),
    "alter_rename_col": (_MAKE + _FILL + "ALTER TABLE t RENAME COLUMN region TO area; SELECT id, area FROM t", "SELECT n_nationkey AS id, n_regionkey AS area FROM nation"),
    "alter_drop_col": (_MAKE + _FILL + "ALTER TABLE t DROP COLUMN region; SELECT * FROM t", "SELECT n_nationkey AS id, n_name AS name FROM nation"),
    "alter_rename_table": (_MAKE + _FILL + "ALTER TABLE t RENAME TO u; SELECT * FROM u", _BASE),
    "databases": ("CREATE DATABASE IF NOT EXISTS d; USE d;" + _MAKE + _FILL + "USE main; DROP TABLE IF EXISTS t; SELECT x.id AS id FROM d.t x WHERE x.region = 1", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1"),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark).register_parquet(sf_dir, *TABLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql(FLAGSHIP)


def _text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: session(spark, d).execute(sql)[-1]


#: Programs of which some statements are refused; the place of each statement and whether it was refused are the result.
REFUSALS = {
    "drop_table": "CREATE TABLE t (a INT); DROP TABLE t; DROP TABLE t; DROP TABLE IF EXISTS t; SELECT * FROM t; CREATE TABLE t (a INT)",
    "drop_database": "CREATE DATABASE d; USE d; CREATE TABLE t (a INT); DROP DATABASE d; DROP TABLE t; DROP DATABASE d; USE d; DROP DATABASE d; DROP DATABASE IF EXISTS d",
    "constraint_keys": "CREATE TABLE t (a INT PRIMARY KEY, b INT UNIQUE); INSERT INTO t VALUES (1, 1), (2, NULL), (3, NULL); INSERT INTO t VALUES (1, 9); INSERT INTO t VALUES (NULL, 9); INSERT INTO t VALUES (4, 1); INSERT INTO t VALUES (5, 5), (5, 6); UPDATE t SET a = 2 WHERE a = 3; INSERT INTO t VALUES (4, NULL)",
    "constraint_null": "CREATE TABLE t (a INT NOT NULL, b INT NULL, c VARCHAR(3)); INSERT INTO t VALUES (1, NULL, 'abc'); INSERT INTO t VALUES (NULL, 1, 'x'); INSERT INTO t (b) VALUES (1); INSERT INTO t VALUES (2, 2, 'abcd'); UPDATE t SET a = b; UPDATE t SET b = a",
    "constraint_references": "CREATE TABLE p (a INT PRIMARY KEY); INSERT INTO p VALUES (1), (2); CREATE TABLE c (x INT REFERENCES p(a)); INSERT INTO c VALUES (1), (NULL); INSERT INTO c VALUES (3); DELETE FROM p WHERE a = 1; DELETE FROM p WHERE a = 2; UPDATE p SET a = 7; DROP TABLE p; ALTER TABLE p RENAME COLUMN a TO b; DROP TABLE c; DROP TABLE p",
    "call_unknown": "SELECT UPPER(n_name) AS u FROM nation; SELECT COUNT(n_name) AS c FROM nation; SELECT SUM(n_name, n_nationkey) AS s FROM nation; SELECT NOTHING() AS x",
}
_REFUSED = {"drop_table": (3, 5), "drop_database": (4, 7, 8), "constraint_keys": (3, 4, 5, 6, 7), "constraint_null": (3, 4, 5, 6), "constraint_references": (5, 6, 8, 9, 10), "call_unknown": (1, 3, 4)}


def _refused(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s, out = session(spark, d), []
        for i, statement in enumerate(text.split("; "), 1):
            try:
                s.execute(statement)
                out.append((i, False))
            except (TableError, Diagnostic):
                out.append((i, True))
        return spark.createDataFrame(out, "step int, refused boolean")

    return run


def _values(columns: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


#: Sources and their tokens: kind, text, line, column, byte offset.
LEXED = {
    "lex_words": ("SELECT selection _a1 from", [("KEYWORD", "SELECT", 1, 1, 0), ("IDENT", "selection", 1, 8, 7), ("IDENT", "_a1", 1, 18, 17), ("KEYWORD", "from", 1, 22, 21), ("EOF", "", 1, 26, 25)]),
    "lex_space": ("-- x\n/* é\n*/\ta--", [("IDENT", "a", 3, 4, 14), ("EOF", "", 3, 7, 17)]),
    "lex_numbers": (".5 5. 1.5e+2 1e 42.col", [("FLOAT", ".5", 1, 1, 0), ("FLOAT", "5.", 1, 4, 3), ("FLOAT", "1.5e+2", 1, 7, 6), ("INTEGER", "1", 1, 14, 13), ("IDENT", "e", 1, 15, 14), ("INTEGER", "42", 1, 17, 16), ("MARK", ".", 1, 19, 18), ("IDENT", "col", 1, 20, 19), ("EOF", "", 1, 23, 22)]),
    "lex_strings": ("'it''s' '' 'é\nz'x 'open", [("STRING", "it's", 1, 1, 0), ("STRING", "", 1, 9, 8), ("STRING", "é\nz", 1, 12, 11), ("IDENT", "x", 2, 3, 17), ("ILLEGAL", "'open", 2, 5, 19), ("EOF", "", 2, 10, 24)]),
    "lex_operators": ("a<=b<>c!=d>=e==!f", [("IDENT", "a", 1, 1, 0), ("OPERATOR", "<=", 1, 2, 1), ("IDENT", "b", 1, 4, 3), ("OPERATOR", "<>", 1, 5, 4), ("IDENT", "c", 1, 7, 6), ("OPERATOR", "!=", 1, 8, 7), ("IDENT", "d", 1, 10, 9), ("OPERATOR", ">=", 1, 11, 10), ("IDENT", "e", 1, 13, 12), ("OPERATOR", "=", 1, 14, 13), ("OPERATOR", "=", 1, 15, 14), ("ILLEGAL", "!", 1, 16, 15), ("IDENT", "f", 1, 17, 16), ("EOF", "", 1, 18, 17)]),
}
#: A source's diagnostics: code, severity, text and the snippet's marks.
FAULTY = "SELECT @ 'x"
_FAULTS = [
    (1001, "error", "1:8: error [E1001] Illegal Character: unexpected character '@'", "  SELECT @ 'x\n         ^", True, False),
    (1002, "error", "1:10: error [E1002] Unterminated String: string literal opened at 1:10 was never closed", "  SELECT @ 'x\n           ^^", True, False),
]


def _lexed(source: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.createDataFrame([(t.kind.name, t.text, t.span.start.line, t.span.start.column, t.span.start.offset) for t in Lexer(source)], "kind string, text string, l int, c int, o int")


def _faults(spark: SparkSession, d: str) -> DataFrame:
    lexer = Lexer(FAULTY)
    list(lexer)
    found = lexer.diagnostics
    return spark.createDataFrame([(x.code, x.severity.value, str(x), x.snippet(), found.has_code(x.code), found.has_code(2001)) for x in found], "code int, severity string, message string, snippet string, listed boolean, other boolean")


def _ahead(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a parser with one token of lookahead meets them: peeked, taken if it is a word, taken, and how many so far."""
    ahead, out = Lookahead(Lexer("a 1 b").next), []
    for i in range(3):
        peeked, taken = ahead.peek().text, ahead.expect(lambda t: t.kind.name == "IDENT")
        out.append((i, peeked, taken.text if taken else None, None if taken else ahead.next().text, ahead.consumed))
    return spark.createDataFrame(out, "i int, peeked string, expected string, passed string, consumed int")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a change log: the user is the key, an error event deletes it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.when(F.col("event_type") == "error", kv.DELETE).otherwise(kv.PUT).alias("op"), F.col("event_id").alias("file_id"))


def _bytes(log: DataFrame) -> DataFrame:
    return log.select(F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("op").cast("byte").alias("op"), "file_id")


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _flushed(spark: SparkSession, d: str) -> DataFrame:
    """The log's latest records, written as a sorted run in the shared folder and read back."""
    s = Session(spark)
    path = f"{s.root}/run"
    kv.write_run(kv.latest(_bytes(_log(spark, d)), F.col("file_id")), path)
    return spark.read.parquet(path)


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """The log written as two segments, replayed in (segment, offset) order."""
    s = Session(spark)
    log = _bytes(_log(spark, d)).withColumn("segment", F.col("file_id") % 2).withColumnRenamed("file_id", "offset")
    log.write.partitionBy("segment").parquet(f"{s.root}/log")
    return spark.read.parquet(f"{s.root}/log")


def _bloom(spark: SparkSession, d: str) -> DataFrame:
    """A filter of every second customer's name, probed with all names: how many of the added are found, and whether few others are."""
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey") % 2 == 0, F.col("c_name").cast("binary")).toDF("added", "key")
    added = names.where("added").select("key")
    shape = bloom.Shape.of(added.count())
    probed = names.join(bloom.may_contain(names.select("key"), bloom.build(added, shape), shape), "key")
    return probed.agg(F.count_if("added").alias("added"), F.count_if(F.col("added") & F.col("may")).alias("found"), (F.count_if(~F.col("added") & F.col("may")) <= 0.02 * F.count_if(~F.col("added")) + 1).alias("few_others"))


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    """A run of all orders, of files closed at 4096 bytes: whether files are in order, hold enough and not too much."""
    path = f"{Session(spark).root}/run"
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").cast("binary").alias("key"), F.col("o_orderpriority").cast("binary").alias("value"), F.lit(kv.PUT).cast("byte").alias("op"))
    kv.write_run(rows, path, 4096)
    size = F.struct("key", kv.entry_bytes().alias("n"))
    files = kv.read_run(spark, path).groupBy("file").agg(F.count("*").alias("n"), F.sum(kv.entry_bytes()).alias("bytes"), F.max(size)["n"].alias("last"), F.min("key").alias("a"), F.max("key").alias("z"))
    part = F.substring("file", 1, 6)
    ends = F.max("file").over(W.partitionBy(part))  # a range's last file may be short
    before = F.lag("z").over(W.partitionBy(part).orderBy("file"))
    judged = files.select("n", (F.coalesce(before < F.col("a"), F.lit(True))).alias("sorted"), ((F.col("bytes") >= 4096) | (F.col("file") == ends)).alias("full"), (F.col("bytes") - F.col("last") < 4096).alias("closed"))
    return judged.agg(F.sum("n").alias("entries"), F.bool_and("sorted").alias("sorted"), F.bool_and("full").alias("full"), F.bool_and("closed").alias("closed"), (F.count("*") > F.sum("n") / 400).alias("many"))


def _run_get(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of single keys in a stored run of five events, the third one an error that deletes."""
    s = kv.KVStore(spark, f"{Session(spark).root}/kv")
    kv.load(s, [(b"user-1", b"view"), (b"user-2", b"click"), (b"user-3", None), (b"user-4", b"")])
    run = s.flush()
    out = [(k, *s.lookup(run, k.encode())) for k in ("user-1", "user-3", "user-4", "user-9")]
    return spark.createDataFrame([(k, o, None if v is None else v.decode()) for k, o, v in out], "key string, outcome string, value string")


def _kv() -> dict[str, Callable]:
    newest = "file_id"
    return {
        "kv_latest": lambda s, d: _plain(kv.latest(_log(s, d), newest)),
        "kv_get": lambda s, d: _plain(kv.live(_log(s, d).where(F.col("key") == 7), newest)),
        "kv_scan": lambda s, d: _plain(kv.live(_bytes(_log(s, d)), newest).orderBy("key")),
        "kv_log": lambda s, d: _logged(s, d).groupBy("op").agg(F.count("*").alias("n"), F.max("offset").alias("last")),
        "kv_replay": lambda s, d: _plain(kv.live(_logged(s, d), F.struct("segment", "offset"))),
        "kv_flush": lambda s, d: _plain(_flushed(s, d)),
        "kv_bloom": _bloom,
        "kv_rollover": _rolled,
        "kv_run_get": _run_get,
        "kv_crc": lambda s, d: _bytes(_log(s, d)).select(F.col("file_id").alias("event_id"), kv.crc(F.col("key"), F.col("value"), F.col("op")).alias("crc")),
        "kv_compact": lambda s, d: _plain(kv.compact(_bytes(_log(s, d)), bottom=False)),
        "kv_compact_bottom": lambda s, d: _plain(kv.compact(_bytes(_log(s, d)), bottom=True)),
    }


_LATEST = "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id"
_LIVE = f"SELECT * FROM ({_LATEST}) WHERE value <> 'error'"
_KV_SQL = {
    "kv_latest": _LATEST,
    "kv_get": _LIVE + " AND key = '7'",
    "kv_scan": _LIVE,
    "kv_log": "SELECT CAST(event_type = 'error' AS TINYINT) AS op, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY 1",
    "kv_replay": "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (event_id % 2) * 1000000000000 + event_id) AS value FROM events GROUP BY user_id) WHERE value <> 'error'",
    "kv_flush": _LATEST,
    "kv_compact": _LATEST,
    "kv_bloom": "SELECT COUNT(*) FILTER (c_custkey % 2 = 0) AS added, COUNT(*) FILTER (c_custkey % 2 = 0) AS found, TRUE AS few_others FROM customer",
    "kv_rollover": "SELECT COUNT(*) AS entries, TRUE AS sorted, TRUE AS \"full\", TRUE AS closed, TRUE AS many FROM orders",
    "kv_run_get": _values("key, outcome, value", [("user-1", "value", "view"), ("user-3", "deleted", None), ("user-4", "value", ""), ("user-9", "absent", None)]),
    # CRC-32 bit by bit over op, key length (two bytes) and the characters of key and value, which are ASCII
    "kv_crc": """
        WITH e AS (SELECT event_id, CAST(event_type = 'error' AS INT) AS op, CAST(user_id AS VARCHAR) AS k, event_type AS v FROM events),
        b AS (SELECT event_id, list_concat([op, len(k) % 256, len(k) // 256], list_transform(range(1, len(k || v) + 1), lambda i: ascii(substr(k || v, i, 1)))) AS bytes FROM e)
        SELECT event_id, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) AS crc FROM b""",
    "kv_compact_bottom": _LIVE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": flagship}
    out |= {k: _text(v) for k, v in SELECTS.items()}
    out |= {k: _text(v) for k, (v, _) in PROGRAMS.items()}
    out |= {k: _refused(v) for k, v in REFUSALS.items()}
    out |= {k: _lexed(v) for k, (v, _) in LEXED.items()} | {"diagnostics": _faults, "lookahead": _ahead}
    return out | _kv()


def oracle_sql() -> dict[str, str]:
    refused = {k: _values("step, refused", [(i, i in _REFUSED[k]) for i in range(1, 1 + len(v.split("; ")))]) for k, v in REFUSALS.items()}
    lexed = {k: _values("kind, text, l, c, o", v) for k, (_, v) in LEXED.items()}
    lexed["diagnostics"] = _values("code, severity, message, snippet, listed, other", _FAULTS)
    lexed["lookahead"] = _values("i, peeked, expected, passed, consumed", [(0, "a", "a", None, 1), (1, "1", None, "1", 2), (2, "b", "b", None, 3)])
    return {"flagship": FLAGSHIP} | SELECTS | _AS_SQL | {k: v for k, (_, v) in PROGRAMS.items()} | refused | lexed | _KV_SQL
