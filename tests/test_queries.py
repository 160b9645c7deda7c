import duckdb
import pytest

from tidemark import queries as Q
from tidemark.session import Session
from tidemark.sql.diagnostics import Diagnostic

DATA = "/root/testdata/sf0.001"
FUNCTIONS, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_same_as_duckdb(spark, duck, name):
    got = FUNCTIONS[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())
    else:
        assert data


@pytest.fixture(scope="module")
def small(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, "a\\b", None), (2, "axb", 0.5), (None, None, -1.0), (2, "A%", 2.0)], "a int, s string, d double"))
    return s


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT a FROM t WHERE a NOT IN (1, NULL)", []),
        (r"SELECT s FROM t WHERE s LIKE 'a\b'", [("a\\b",)]),
        (r"SELECT s FROM t WHERE s LIKE s AND a = 1", [("a\\b",)]),
        ("SELECT a FROM t ORDER BY a", [(1,), (2,), (2,), (None,)]),
        ("SELECT a FROM t ORDER BY a DESC", [(2,), (2,), (1,), (None,)]),
        ("SELECT COUNT(DISTINCT a, s) AS c, SUM(a > 1) AS s, AVG(DISTINCT a) AS v FROM t", [(3, 2, 1.5)]),
        ("SELECT COUNT(*) AS c FROM t WHERE FALSE HAVING COUNT(*) = 0", [(0,)]),
        ("SELECT a AS x, COUNT(*) AS c FROM t GROUP BY x HAVING x IS NOT NULL ORDER BY MAX(d) DESC", [(2, 2), (1, 1)]),
        ("SELECT T.A FROM t WHERE D", [(2,), (None,), (2,)]),
        ("SELECT -7 / 2 AS a, -7 % 3 AS b, 'it''s\\n' AS c", [(-3.5, -1, "it's\\n")]),
        ("SELECT x.a AS p FROM t x LEFT JOIN t y ON x.a > y.a WHERE y.a IS NULL AND x.a IS NOT NULL", [(1,)]),
        ("SELECT DISTINCT a FROM t ORDER BY a LIMIT 2 OFFSET 1", [(2,), (None,)]),
    ],
)
def test_semantics(small, sql, want):
    assert [tuple(r) for r in small.sql(sql).collect()] == want


@pytest.mark.parametrize(
    "sql,code",
    [
        ("SELECT b FROM t", 3001), ("SELECT a FROM t x, t y", 3002), ("SELECT a FROM t, t", 3002), ("SELECT u.* FROM t", 3003), ("SELECT 99999999999999999999", 3004), ("SELECT s + 1 FROM t", 3005),
        ("SELECT a FROM t WHERE COUNT(*) > 1", 3006), ("SELECT SUM(COUNT(a)) FROM t", 3006), ("SELECT UPPER(s) FROM t", 3007), ("SELECT a FROM t WHERE s", 3008), ("SELECT SUM(*) FROM t", 3009), ("SELECT SUM(a, d) FROM t", 3009),
        ("SELECT s FROM t GROUP BY a", 3010), ("SELECT a FROM t HAVING COUNT(*) > 1", 3010), ("SELECT a FROM t ORDER BY 1", 3011), ("SELECT DISTINCT a FROM t ORDER BY d", 3012),
    ],
)
def test_faults(small, sql, code):
    with pytest.raises(Diagnostic) as e:
        small.sql(sql)
    assert e.value.code == code and e.value.full()


def test_plans(spark):
    s = Session(spark).register_parquet(DATA, "lineitem", "nation", "region")
    plan = s.sql("SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.05")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "l_shipdate" not in plan
    joined = s.sql(Q.SELECTS["comma_join"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joined and "NestedLoop" not in joined
