import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vellum.functions.dialect import DialectError, format_time
from vellum.session import ConstraintError, TransactionError, open_engine
from vellum.sources.store import ConflictError


@pytest.fixture(params=["journal", "audit"])
def engine(request, spark, tmp_path):
    return open_engine(tmp_path / "db", spark, request.param, durability="off")


@pytest.fixture
def s(engine):
    return engine.session()


def rows(s, text, args=None):
    return [tuple(r) for r in s.query(text, args).collect()]


def test_crud_and_reopen(engine, s, spark, tmp_path):
    s.execute("CREATE TABLE issues (id BIGINT PRIMARY KEY, title VARCHAR(200) NOT NULL, closed BOOLEAN NOT NULL)")
    assert s.execute("INSERT INTO issues VALUES (1, 'a', 0), (2, 'b', 1), (3, ?, ?)", ["c", 0]) == 3
    assert s.execute("UPDATE issues SET title = 'z' WHERE id >= 2") == 2
    assert s.execute("UPDATE issues SET title = 'z' WHERE id >= 2") == 0
    assert s.execute("DELETE FROM issues WHERE id = ?", [3]) == 1
    want = [(1, "a", 0), (2, "z", 1)]
    assert rows(s, "SELECT * FROM issues ORDER BY id") == want
    again = open_engine(tmp_path / "db", spark, engine.mode, create=False)
    again.checkpoint()
    assert rows(again.session(), "SELECT * FROM Issues ORDER BY id") == want
    assert again.row_count("issues") == (2, True)
    assert again.checkpoint() == again.store.head().id


def test_constraints(s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, email VARCHAR(20), age INT, UNIQUE KEY e (email), CHECK (age >= 0))")
    s.execute("INSERT INTO t VALUES (1, 'a', 1), (2, NULL, NULL), (3, NULL, 3)")
    for bad in ("(1, 'x', 1)", "(9, 'a', 1)", "(9, 'x', -1)", "(NULL, 'x', 1)", "(9, 'x', 1), (9, 'y', 1)", "(8, 'x', 1), (9, 'x', 1)"):
        with pytest.raises(ConstraintError):
            s.execute(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(Exception, match="too long"):
        s.execute("INSERT INTO t VALUES (9, 'aaaaaaaaaaaaaaaaaaaaaaaaa', 1)")
    with pytest.raises(ConstraintError):
        s.execute("UPDATE t SET email = 'q'")
    assert rows(s, "SELECT count(*) FROM t") == [(3,)]
    assert s.execute("UPDATE t SET id = id + 1") == 3  # keys move over one another
    assert rows(s, "SELECT id, email, age FROM t ORDER BY id") == [(2, "a", 1), (3, None, None), (4, None, 3)]


def test_ignore_and_upsert(s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, n INT DEFAULT 5, tag VARCHAR(9) DEFAULT 'none')")
    s.execute("INSERT INTO t (id) VALUES (1), (2)")
    assert s.execute("INSERT IGNORE INTO t VALUES (2, 9, 'x'), (3, 9, 'x'), (3, 8, 'y')") == 1
    assert s.execute("INSERT INTO t VALUES (1, 10, 'u'), (7, 7, 'v') ON DUPLICATE KEY UPDATE n = n + VALUES(n)") == 2
    assert rows(s, "SELECT * FROM t ORDER BY id") == [(1, 15, "none"), (2, 5, "none"), (3, 9, "x"), (7, 7, "v")]
    assert s.execute("INSERT INTO t (id, n) SELECT id + 100, n FROM t WHERE n > 5") == 3
    assert rows(s, "SELECT count(*) FROM t") == [(7,)]


def test_transactions(engine, s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    s.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    other = engine.session()
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 10 WHERE id = 1")
    assert rows(s, "SELECT v FROM t WHERE id = 1") == [(10,)] and rows(other, "SELECT v FROM t WHERE id = 1") == [(1,)]
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO t VALUES (2, 0)")  # undoes itself alone
    other.execute("UPDATE t SET v = 20 WHERE id = 2")
    assert rows(s, "SELECT v FROM t WHERE id = 2") == [(2,)]
    if engine.mode == "journal":
        s.execute("COMMIT")
        assert rows(other, "SELECT v FROM t ORDER BY id") == [(10,), (20,)]
        assert engine.recover_commit(s.last_transaction) == "committed"
    else:
        with pytest.raises(ConflictError):
            s.execute("COMMIT")
        assert engine.recover_commit(s.last_transaction) == "rejected"
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 0")
    s.execute("ROLLBACK")
    assert rows(s, "SELECT max(v) FROM t") == [(20,)]
    assert engine.recover_commit("nobody") == "unknown"
    s.execute("START TRANSACTION READ ONLY")
    with pytest.raises(TransactionError):
        s.execute("DELETE FROM t")


def test_first_committer_wins(engine, s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, u INT, UNIQUE KEY uk (u))")
    s.execute("INSERT INTO t VALUES (1, 1)")
    other = engine.session()
    for mine, theirs in (("UPDATE t SET u = 5 WHERE id = 1", "UPDATE t SET u = 6 WHERE id = 1"), ("INSERT INTO t VALUES (10, 50)", "INSERT INTO t VALUES (11, 50)"), ("INSERT INTO t VALUES (20, 51)", "ALTER TABLE t ADD COLUMN x INT")):
        s.begin()
        s.execute(mine)
        other.execute(theirs)
        with pytest.raises(ConflictError):
            s.commit()
    s.begin()
    s.execute("INSERT INTO t VALUES (30, 60, 1)")
    engine.checkpoint()
    if engine.mode == "journal":
        with pytest.raises(ConflictError):
            s.commit()


def test_alter(s):
    s.execute("CREATE TABLE t (a BIGINT, b BIGINT, c VARCHAR(20), PRIMARY KEY (a, b), KEY ic (c))")
    s.execute("INSERT INTO t VALUES (1, 1, '7'), (2, 1, '8')")
    s.execute("ALTER TABLE t ADD COLUMN d INT DEFAULT 4 AFTER a")
    assert rows(s, "SELECT * FROM t ORDER BY a") == [(1, 4, 1, "7"), (2, 4, 1, "8")]
    with pytest.raises(ConstraintError):
        s.execute("ALTER TABLE t ADD COLUMN e INT NOT NULL")
    with pytest.raises(DialectError):
        s.execute("ALTER TABLE t DROP COLUMN c")
    s.execute("ALTER TABLE t DROP INDEX ic")
    s.execute("ALTER TABLE t MODIFY COLUMN c INT FIRST")
    s.execute("ALTER TABLE t RENAME COLUMN c TO cc, ADD CHECK (cc > 0)")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO t VALUES (0, 9, 9, 9)")
    with pytest.raises(ConstraintError):
        s.execute("ALTER TABLE t DROP COLUMN a")
    s.execute("ALTER TABLE t DROP COLUMN b")
    s.execute("ALTER TABLE t DROP CHECK t_chk_1, ADD UNIQUE KEY u (cc), RENAME INDEX u TO uu")
    assert rows(s, "SHOW INDEX FROM t") == [("PRIMARY", 0, 1, "a"), ("uu", 0, 1, "cc")]
    with pytest.raises(Exception, match="CAST|overflow|range"):
        s.execute("INSERT INTO t VALUES (500, 9, 4)")
        s.execute("ALTER TABLE t MODIFY cc TINYINT")
    assert [r[0] for r in rows(s, "DESCRIBE t")] == ["cc", "a", "d"]
    text = rows(s, "SHOW CREATE TABLE t")[0][1]
    s.execute("DROP TABLE t")
    s.execute(text)
    assert rows(s, "SELECT table_name FROM information_schema.tables") == [("t",)]


def test_types(s):
    s.execute("CREATE TABLE t (id BIGINT UNSIGNED PRIMARY KEY, p DECIMAL(10,2), d DATE, t TIME, dt DATETIME(6), j JSON, e ENUM('small','medium','large'), n VARCHAR(20) COLLATE utf8mb4_general_ci, b VARBINARY(9))")
    s.execute("INSERT INTO t VALUES (18446744073709551615, 2.345, '2020-02-29', '-01:15:00', '2020-01-01 10:00:00.123456', '{\"b\":1,\"a\":2}', 'medium', 'Ann', X'00FF')")
    s.execute("INSERT INTO t (id, t, e, n) VALUES (1, '838:59:59', 'large', 'bob'), (2, '0:01:02', 'small', NULL)")
    got = rows(s, "SELECT id, p, d, dt, j, e, n, b FROM t WHERE n = 'ANN'")
    assert got == [(Decimal(18446744073709551615), Decimal("2.35"), datetime.date(2020, 2, 29), datetime.datetime(2020, 1, 1, 10, 0, 0, 123456), '{"a":2,"b":1}', "medium", "Ann", bytearray(b"\x00\xff"))]
    assert [r[0] for r in s.rows("t").orderBy("id").select(format_time(F.col("t"))).collect()] == ["838:59:59", "00:01:02", "-01:15:00"]
    assert [r[0] for r in rows(s, "SELECT e FROM t ORDER BY e DESC")] == ["large", "medium", "small"]
    assert rows(s, "SELECT JSON_UNQUOTE(JSON_EXTRACT(j, '$.a')), JSON_OBJECT('x', 1) FROM t WHERE j IS NOT NULL") == [("2", '{"x":1}')]
    for bad in ("(-1, NULL)", "(3, 'huge')"):
        with pytest.raises(Exception, match="range|enum"):
            s.execute(f"INSERT INTO t (id, e) VALUES {bad}")


@pytest.mark.parametrize(
    "text",
    ["CREATE TABLE t (a INT)", "CREATE TABLE t (a JSON PRIMARY KEY)", "CREATE TABLE t (a YEAR PRIMARY KEY)", "CREATE TABLE t (a INT AUTO_INCREMENT PRIMARY KEY)", "CREATE VIEW v AS SELECT 1", "REPLACE INTO t VALUES (1)", "TRUNCATE TABLE t", "SAVEPOINT x",
     "CREATE TABLE t (a INT PRIMARY KEY, FOREIGN KEY (a) REFERENCES b (c))", "CREATE TABLE t (a VARCHAR(9), PRIMARY KEY (a(3)))", "CREATE DATABASE x", "RENAME TABLE a TO b", "CREATE TABLE t (a DECIMAL(40,10) PRIMARY KEY)", "USE other", "FROB"],
)
def test_rejections(s, text):
    with pytest.raises(DialectError):
        s.execute(text)


def test_history_and_diff(engine, s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    s.execute("INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)")
    first = engine.checkpoint()
    s.execute("UPDATE t SET v = 9 WHERE id = 1")
    s.execute("DELETE FROM t WHERE id = 2")
    s.execute("INSERT INTO t VALUES (4, 4)")
    assert engine.diff() == ({"t": "modified"} if engine.mode == "journal" else {})
    second = engine.checkpoint()
    got = {(r["id"], r["change"]) for r in engine.diff_rows("t", first, second).collect()}
    assert got == {(1, "modified"), (2, "deleted"), (4, "added")}
    assert sorted(r["v"] for r in engine.table_at("t", first).collect()) == [1, 2, 3]
    assert engine.row_count("t") == (3, True)


def test_explain_pushes_down(s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT, w INT)")
    s.execute("INSERT INTO t VALUES (1, 1, 1)")
    s.engine.checkpoint()
    plan = "\n".join(r[0] for r in rows(s, "EXPLAIN SELECT v FROM t WHERE id = 1"))
    assert "PushedFilters" in plan and "GreaterThan" not in plan and "w" not in plan.split("ReadSchema")[1].split("\n")[0].replace("struct", "")


def test_fractions_are_rounded(s):
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, a DATETIME, b DATETIME(3), c TIMESTAMP(6), d TIME(3), e TIME)")
    s.execute("INSERT INTO t VALUES (1, '2020-01-01 00:00:59.5', '2020-01-01 00:00:00.1236', '2020-01-01 00:00:00.123456', '1:02:03.4567', '-0:00:01.5')")
    got = rows(s, "SELECT a, b, c FROM t")[0]
    assert [v.isoformat() for v in got] == ["2020-01-01T00:01:00", "2020-01-01T00:00:00.124000", "2020-01-01T00:00:00.123456"]
    assert tuple(s.rows("t").select(format_time(F.col("d"), 3), format_time(F.col("e"))).first()) == ("01:02:03.457", "-00:00:02")


def test_dialect_in_changes(engine):
    """Functions of the dialect, and subqueries, wherever an expression may stand."""
    s = engine.session()
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, doc JSON, n INT DEFAULT 3, CONSTRAINT c CHECK (JSON_EXTRACT(doc, '$.bad') IS NULL))")
    s.execute("INSERT INTO t (id, doc) VALUES (1, '{\"k\": 1}'), (2, '{\"k\": 2}'), (3, '{\"k\": 1}')")
    with pytest.raises(ConstraintError, match="check c"):
        s.execute("UPDATE t SET doc = '{\"bad\": 1}' WHERE id = 1")
    assert s.execute("UPDATE t SET n = JSON_EXTRACT(doc, '$.k') + ? WHERE JSON_EXTRACT(doc, '$.k') = ?", [10, "1"]) == 2
    assert s.execute("UPDATE t SET n = DEFAULT WHERE id IN (SELECT max(id) FROM t)") == 1
    assert [tuple(r) for r in s.query("SELECT id, n FROM t ORDER BY id").collect()] == [(1, 11), (2, 3), (3, 3)]
    assert s.execute("DELETE FROM t WHERE JSON_EXTRACT(doc, '$.k') = '1' AND EXISTS (SELECT 1 FROM t x WHERE x.id = t.id + 1)") == 1
    assert [r.id for r in s.query("SELECT id FROM t ORDER BY id").collect()] == [2, 3]


def test_enum_order_follows_the_column(engine):
    s = engine.session()
    s.execute("CREATE TABLE e (id BIGINT PRIMARY KEY, state ENUM('new', 'old', 'gone'))")
    s.execute("CREATE TABLE p (id BIGINT PRIMARY KEY, state VARCHAR(9))")
    s.execute("INSERT INTO e VALUES (1, 'gone'), (2, 'new'), (3, 'old'), (4, NULL)")
    s.execute("INSERT INTO p VALUES (1, 'zeta'), (2, 'alpha'), (3, 'new'), (4, 'old')")
    column = lambda q: [r[0] for r in s.query(q).collect()]
    assert column("SELECT state FROM p ORDER BY state") == ["alpha", "new", "old", "zeta"]
    assert column("SELECT state FROM e ORDER BY state") == [None, "new", "old", "gone"]
    assert column("SELECT state, id FROM e WHERE state IS NOT NULL ORDER BY 1 DESC LIMIT 2") == ["gone", "old"]
    assert column("SELECT x FROM (SELECT state AS x FROM e) y WHERE x IS NOT NULL ORDER BY x") == ["new", "old", "gone"]
    assert column("SELECT e.id FROM e JOIN p ON e.id = p.id ORDER BY p.state, e.state") == [2, 3, 4, 1]


def test_functions_of_the_dialect(engine):
    s = engine.session()
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, at TIME(3), w VARCHAR(20))")
    s.execute("INSERT INTO t VALUES (1, '12:34:56', 'é'), (2, '-101:00:01', 'b'), (3, NULL, 'b')")
    one = lambda q: s.query(q).collect()
    assert [tuple(r) for r in one("SELECT LENGTH(w), CHAR_LENGTH(w), CAST(at AS CHAR), CAST(id AS CHAR(1)) FROM t ORDER BY id")] == [(2, 1, "12:34:56", "1"), (1, 1, "-101:00:01", "2"), (1, 1, None, "3")]
    assert one("SELECT GROUP_CONCAT(DISTINCT w ORDER BY w SEPARATOR '; ') AS g, GROUP_CONCAT(id ORDER BY id DESC) AS i FROM t")[0] == ("b; é", "3,2,1")
    assert [r.id for r in one("SELECT id FROM t ORDER BY id LIMIT 1, 2")] == [2, 3]
    assert "vellum" in one("SELECT VERSION()")[0][0]
    assert one(f"SELECT vellum_recover_commit('{s.last_transaction}') AS o")[0].o == "committed"


def test_files_are_pruned_by_key(engine, spark, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "FILE_BYTES", 2000)
    s = engine.session()
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(40))")
    s.execute("INSERT INTO t SELECT id, md5(CAST(id AS STRING)) FROM range(500)")
    engine.checkpoint()
    files = lambda q, a=None: len(s.query(q, a).inputFiles())
    every = files("SELECT * FROM t")
    assert every >= 3
    assert files("SELECT v FROM t WHERE id = 42") == 1 and files("SELECT v FROM t WHERE v <> 'x' AND t.id >= ? LIMIT 3", [499]) == 1
    assert files("SELECT v FROM t x WHERE x.id BETWEEN 3 AND 4 AND v > ''") == 1 and 1 <= files("SELECT v FROM t WHERE id IN (0, 499)") <= 2
    for q in ("SELECT v FROM t WHERE id = 42 OR v = 'a'", "SELECT v FROM t WHERE CASE WHEN v > '' AND id = 3 AND v < 'z' THEN 1 ELSE 1 END = 1", "SELECT a.v FROM t a, t b WHERE a.id = 3 AND b.id = 4"):
        assert files(q) >= every
    s.execute("UPDATE t SET v = 'changed' WHERE id = 42")
    assert [r.v for r in s.query("SELECT v FROM t WHERE id = 42").collect()] == ["changed"]
    assert s.query("SELECT v FROM t WHERE id = 500").collect() == []
    engine.checkpoint()
    assert [r.v for r in s.query("SELECT v FROM t WHERE id = 42").collect()] == ["changed"]
    plan = s.query("SELECT COUNT(*) AS n FROM t")
    assert plan.collect()[0].n == 500 and not plan.inputFiles()


def test_many_edits_in_small_files_are_not_broadcast(engine):
    s = engine.session()
    s.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    plan = lambda t: s.rows(t)._jdf.queryExecution().executedPlan().toString()
    for t, n in (("many", 30000), ("few", 3)):
        s.execute(f"CREATE TABLE {t} (id BIGINT PRIMARY KEY, state ENUM('new', 'old'))")
    s.execute("BEGIN")
    for t, n in (("many", 30000), ("few", 3)):
        s.execute(f"INSERT INTO {t} SELECT id, 'new' FROM range({n})")
    assert "SortMergeJoin" in plan("many") and "BroadcastHashJoin" not in plan("many")
    assert "BroadcastHashJoin" in plan("few")
    s.execute("UPDATE many SET id = id + 1 WHERE id >= 15000")
    assert s.execute("INSERT IGNORE INTO many VALUES (1, 'old'), (15000, 'old')") == 1
    assert s.execute("INSERT INTO many VALUES (2, 'old'), (40000, 'old') ON DUPLICATE KEY UPDATE state = VALUES(state)") == 2
    s.execute("COMMIT")
    if engine.mode == "journal":
        assert "SortMergeJoin" in plan("many") and "BroadcastHashJoin" not in plan("many") and "BroadcastHashJoin" in plan("few")
    engine.checkpoint()
    assert rows(s, "SELECT count(*), count(DISTINCT id), max(id), count_if(state = 'old') FROM many") == [(30002, 30002, 40000, 3)]
    assert engine.row_count("many") == (30002, True)
