import pytest

from tidemark.session import Session
from tidemark.sources.tables import TableError


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db")


def rows(s, sql):
    return sorted([tuple(r) for r in s.execute(sql)[-1].collect()], key=repr)


def test_changes(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(5) NOT NULL, n BIGINT UNIQUE DEFAULT 3)")
    assert rows(s, "SELECT * FROM t") == []
    s.execute("INSERT INTO t VALUES (1, 'a', 10); INSERT INTO t (name, id) VALUES ('b', 2)")
    assert rows(s, "SELECT * FROM t") == [(1, "a", 10), (2, "b", 3)]
    for bad in (
        "INSERT INTO t VALUES (1, 'x', 99)", "INSERT INTO t VALUES (5, 'toolong', 99)", "INSERT INTO t VALUES (5, NULL, 99)", "INSERT INTO t VALUES (5, 'x', 10)", "INSERT INTO t VALUES (NULL, 'x', 98)",
        "UPDATE t SET id = 1", "ALTER TABLE t ADD name INT", "ALTER TABLE t DROP COLUMN zz", "INSERT INTO t (id) VALUES (7)", "CREATE TABLE t (a INT)", "DROP TABLE u", "INSERT INTO t VALUES (1)",
    ):
        with pytest.raises(TableError):
            s.execute(bad)
    assert rows(s, "SELECT * FROM t") == [(1, "a", 10), (2, "b", 3)]
    s.execute("INSERT INTO t VALUES (3, 'c', NULL), (4, 'd', NULL)")  # NULLs are not equal
    s.execute("UPDATE t SET n = id, id = n WHERE id = 1; DELETE FROM t WHERE n > 2")
    assert rows(s, "SELECT * FROM t") == [(10, "a", 1), (3, "c", None), (4, "d", None)]
    s.execute("DELETE FROM t")
    assert rows(s, "SELECT COUNT(*) AS c FROM t") == [(0,)]


def test_self_insert_and_references(s):
    s.execute("CREATE TABLE u (id INT PRIMARY KEY); INSERT INTO u VALUES (1), (2); INSERT INTO u SELECT id + 10 FROM u")
    assert rows(s, "SELECT * FROM u") == [(1,), (11,), (12,), (2,)]
    s.execute("CREATE TABLE v (u INT REFERENCES u(id)); INSERT INTO v VALUES (1), (NULL)")
    with pytest.raises(TableError):
        s.execute("INSERT INTO v VALUES (3)")
    with pytest.raises(TableError):
        s.execute("CREATE TABLE w (a INT REFERENCES nothing(id))")


def test_databases(s):
    s.execute("CREATE DATABASE d; CREATE DATABASE IF NOT EXISTS d; USE d; CREATE TABLE t (a INT)")
    for bad in ("CREATE DATABASE d", "USE x", "DROP DATABASE d"):
        with pytest.raises(TableError):
            s.execute(bad)
    s.execute("DROP TABLE t; DROP TABLE IF EXISTS t; DROP DATABASE d; DROP DATABASE IF EXISTS d")
    assert s.database == "main"


def test_second_writer_fails(s):
    s.execute("CREATE TABLE t (a INT)")
    m = s.catalog.manifest("main", "t")
    s.execute("INSERT INTO t VALUES (1)")
    m.version += 1
    with pytest.raises(TableError):
        s.catalog._commit("main", "t", m)


def test_references_hold_when_parents_change(s):
    s.execute("CREATE TABLE p (id INT PRIMARY KEY, n INT); INSERT INTO p VALUES (1, 1), (2, 2), (3, 3); CREATE TABLE c (p INT REFERENCES p(id)); INSERT INTO c VALUES (1), (2)")
    for bad in ("DELETE FROM p WHERE id = 1", "UPDATE p SET id = 9 WHERE id = 2", "DELETE FROM p", "DROP TABLE p", "ALTER TABLE p RENAME TO q", "ALTER TABLE p RENAME COLUMN id TO i", "ALTER TABLE p DROP COLUMN id"):
        with pytest.raises(TableError):
            s.execute(bad)
    s.execute("DELETE FROM p WHERE id = 3; UPDATE p SET n = 7 WHERE id = 1; ALTER TABLE p DROP COLUMN n")
    assert rows(s, "SELECT * FROM p") == [(1,), (2,)]
    s.execute("DROP TABLE c; DROP TABLE p")


def test_changes_rewrite_only_parts_with_hits(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, n INT); INSERT INTO t VALUES (1, 1), (2, 2); INSERT INTO t VALUES (3, 3); INSERT INTO t VALUES (4, 4)")
    parts = lambda: [p[0] for p in s.catalog.manifest("main", "t").parts]
    before = parts()
    s.execute("UPDATE t SET n = 10 WHERE id = 3; DELETE FROM t WHERE id = 99")
    assert len(parts()) == 3 and {*before} - {*parts()} == {before[1]}
    with pytest.raises(TableError):
        s.execute("UPDATE t SET id = 1 WHERE id = 3")
    s.execute("DELETE FROM t WHERE n = 10")
    assert rows(s, "SELECT * FROM t") == [(1, 1), (2, 2), (4, 4)]


def test_alter_changes_the_manifest_alone(s):
    s.execute("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2)")
    before = s.catalog.manifest("main", "t").parts
    s.execute("ALTER TABLE t ADD c INT DEFAULT 5; ALTER TABLE t RENAME COLUMN b TO x; ALTER TABLE t DROP COLUMN a; ALTER TABLE t ADD b TEXT; ALTER TABLE t MODIFY COLUMN c INT DEFAULT 6 NOT NULL")
    assert s.catalog.manifest("main", "t").parts == before and rows(s, "SELECT * FROM t") == [(2, 5, None)]
    s.execute("INSERT INTO t (x) VALUES (8)")
    assert rows(s, "SELECT x, c, b FROM t") == [(2, 5, None), (8, 6, None)]
    for bad in ("ALTER TABLE t ADD d INT NOT NULL", "ALTER TABLE t ADD d INT DEFAULT 1 UNIQUE", "ALTER TABLE t MODIFY COLUMN b TEXT NOT NULL"):
        with pytest.raises(TableError):
            s.execute(bad)
    s.execute("ALTER TABLE t MODIFY COLUMN x BIGINT; ALTER TABLE t RENAME COLUMN x TO a; UPDATE t SET a = a + 3000000000 WHERE c = 6")
    assert rows(s, "SELECT a, c FROM t") == [(2, 5), (3000000008, 6)]


def test_many_values_are_one_relation(s):
    import time

    s.execute("CREATE TABLE t (a INT, b TEXT, c BIGINT)")
    began = time.perf_counter()
    s.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, 'x{i}', {i} * 2)" for i in range(1000)))
    assert time.perf_counter() - began < 20
    assert rows(s, "SELECT COUNT(*) AS c, SUM(c) AS s FROM t") == [(1000, 999000)]
