"""The driver's queries of what keeps state: sessions, transactions, definitions, versions, exchange.

Each makes a store of its own under the work folder, runs statements on whole tables, and gives rows that SQL can repeat.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import sync
from vellum.check import check
from vellum.functions.dialect import DialectError
from vellum.session import ConstraintError, Engine, Session, TransactionError, open_engine
from vellum.sources import files
from vellum.sources.store import ConflictError

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = "CREATE TABLE o (id BIGINT PRIMARY KEY, customer BIGINT NOT NULL, status VARCHAR(8), cents BIGINT)"
_O = "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS cents FROM orders"


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a store: under the shared work folder, which must be a mounted one, or on one machine a folder of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="vellum-")
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if not root.startswith("/"):
        raise RuntimeError("a store needs a mounted folder in spark.checkpoint.dir")
    return f"{root}/vellum-{name}-{uuid.uuid4().hex}"


class Place:
    """What a scenario works with: the session, the tables, and new engines over them."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str):
        self.spark, self.sf_dir, self.name = spark, sf_dir, name

    def engine(self, mode: str = "journal") -> Engine:
        return open_engine(folder(self.spark, self.name), self.spark, mode, durability="normal")

    def session(self, *texts: str, mode: str = "journal", tables: Sequence[str] = ("orders",)) -> Session:
        """A session of a new store, with the tables as views, after some statements."""
        return self.open(self.engine(mode), *texts, tables=tables)

    def open(self, engine: Engine, *texts: str, tables: Sequence[str] = ("orders",)) -> Session:
        s = engine.session()
        for t in tables:
            s.adopt(self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet"), t)
        for text in texts:
            s.execute(text)
        return s

    def rows(self, rows: Sequence[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def scenario(oracle: str):
    """Registers a function of a Place."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Place(spark, sf_dir, f.__name__))
        ORACLES[f.__name__] = oracle
        return f

    return keep


def outcome(run: Callable[[], object]) -> str:
    """What came of a statement: done, or the kind of its error."""
    try:
        run()
    except (DialectError, ConstraintError, TransactionError, ConflictError, sync.MergeInvalid) as e:
        return type(e).__name__
    return "done"


def values(rows: Sequence[tuple], names: str) -> str:
    """Rows as SQL."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


FILL = f"INSERT INTO o {_O}"

# -- the dialect in a session ------------------------------------------------------------------------------------------


@scenario("SELECT p_partkey AS id, CAST(strlen(p_name || 'é') AS BIGINT) AS bytes, length(p_name || 'é') AS chars FROM part")
def length_bytes(at: Place) -> DataFrame:
    s = at.session("CREATE TABLE p (id BIGINT PRIMARY KEY, w VARCHAR(200))", "INSERT INTO p SELECT p_partkey, concat(p_name, 'é') FROM part", tables=["part"])
    return s.query("SELECT id, CAST(LENGTH(w) AS BIGINT) AS bytes, CAST(CHAR_LENGTH(w) AS BIGINT) AS chars FROM p")


_TIME = "lpad(CAST(id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 59 AS VARCHAR), 2, '0')"


@scenario(f"SELECT id, {_TIME} AS at FROM ({_O}) t")
def cast_time(at: Place) -> DataFrame:
    made = _TIME.replace("VARCHAR", "STRING").replace("id", "o_orderkey")
    s = at.session("CREATE TABLE t (id BIGINT PRIMARY KEY, at TIME)", f"INSERT INTO t SELECT o_orderkey, {made} FROM orders")
    return s.query("SELECT id, CAST(at AS CHAR) AS at FROM t")


@scenario("SELECT o_orderkey AS id, CAST(list_position(['P', 'O', 'F'], o_orderstatus) AS BIGINT) AS place FROM orders")
def enum_order_session(at: Place) -> DataFrame:
    """The place of a row's status among all in the order that ORDER BY gives; another table has a text column of that name."""
    s = at.session(
        "CREATE TABLE e (id BIGINT PRIMARY KEY, status ENUM('P', 'O', 'F'))",
        "CREATE TABLE w (id BIGINT PRIMARY KEY, status VARCHAR(9))",
        "INSERT INTO e SELECT o_orderkey, o_orderstatus FROM orders",
        "INSERT INTO w VALUES (1, 'P'), (2, 'F'), (3, 'O')",
    )
    listed = [r[0] for r in s.query("SELECT DISTINCT status FROM e ORDER BY status").collect()]
    if [r[0] for r in s.query("SELECT status FROM w ORDER BY status").collect()] != ["F", "O", "P"]:
        raise AssertionError("a text column is ordered by its text")
    places = s.spark.createDataFrame([(v, n) for n, v in enumerate(listed, 1)], "status string, place bigint")
    return s.rows("e").join(F.broadcast(places), "status").select("id", "place")


@scenario("SELECT event_id AS id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) * 2 ELSE 0 END AS n FROM events")
def update_json(at: Place) -> DataFrame:
    s = at.session("CREATE TABLE e (id BIGINT PRIMARY KEY, doc JSON, n BIGINT DEFAULT 0)", "INSERT INTO e (id, doc) SELECT event_id, props FROM events", tables=["events"])
    s.execute("UPDATE e SET n = 2 * JSON_EXTRACT(doc, '$.k') WHERE CAST(JSON_EXTRACT(doc, '$.k') AS SIGNED) < ?", [50])
    return s.query("SELECT id, n FROM e")


@scenario(f"SELECT * FROM ({_O}) o WHERE NOT (customer IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND cents > (SELECT avg(cents) FROM ({_O}) x))")
def delete_subquery(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL, "CREATE TABLE c (id BIGINT PRIMARY KEY, segment VARCHAR(20))", "INSERT INTO c SELECT c_custkey, c_mktsegment FROM customer", tables=["orders", "customer"])
    s.execute("DELETE FROM o WHERE customer IN (SELECT id FROM c WHERE segment = 'BUILDING') AND cents > (SELECT avg(cents) FROM o)")
    return s.query("SELECT * FROM o")


@scenario("SELECT c_mktsegment AS segment, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), '; ' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations FROM customer GROUP BY c_mktsegment")
def group_concat_session(at: Place) -> DataFrame:
    s = at.session("CREATE TABLE c (id BIGINT PRIMARY KEY, segment VARCHAR(20), nation VARCHAR(4))", "INSERT INTO c SELECT c_custkey, c_mktsegment, c_nationkey FROM customer", tables=["customer"])
    return s.query("SELECT segment, GROUP_CONCAT(DISTINCT nation ORDER BY nation SEPARATOR '; ') AS nations FROM c GROUP BY segment")


@scenario(f"SELECT id, status FROM ({_O}) o WHERE customer > 20 AND status = 'F' AND cents <= 250000")
def parameters(at: Place) -> DataFrame:
    return at.session(ORDERS, FILL).query("SELECT id, status FROM o WHERE customer > ? AND status = ? AND cents <= ?", [20, "F", 250000])


@scenario(f"SELECT * FROM ({_O}) o WHERE id BETWEEN 1200 AND 1300")
def pruned_range(at: Place) -> DataFrame:
    """A range of the key in a checkpointed table of several files, with an edit pending."""
    s = at.session(ORDERS, FILL)
    s.engine.checkpoint()
    s.execute("UPDATE o SET status = 'Z' WHERE id = 5000")
    return s.query("SELECT * FROM o WHERE id BETWEEN 1200 AND 1300")


@scenario("SELECT count(*) AS n FROM orders")
def count_from_metadata(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    s.engine.checkpoint()
    return s.query("SELECT COUNT(*) AS n FROM o")


_COLUMNS = [("id", "BIGINT", "NO", "PRI"), ("customer", "BIGINT", "NO", "MUL"), ("status", "VARCHAR(8)", "YES", "UNI")]


@scenario(values(_COLUMNS, "field, type, \"null\", \"key\""))
def describe_table(at: Place) -> DataFrame:
    s = at.session("CREATE TABLE o (id BIGINT PRIMARY KEY, customer BIGINT NOT NULL, status VARCHAR(8), KEY ck (customer), UNIQUE KEY sk (status))")
    return s.query("DESCRIBE o").select("field", "type", "null", "key")


@scenario(values([("o", "id", 1), ("o", "customer", 2), ("o", "status", 3), ("o", "cents", 4)], "table_name, column_name, place"))
def information_schema(at: Place) -> DataFrame:
    return at.session(ORDERS).query("SELECT table_name, column_name, CAST(ordinal_position AS SIGNED) AS place FROM information_schema.columns")


@scenario(values([("SHOW TABLES", "o"), ("SHOW INDEX", "PRIMARY"), ("SHOW CREATE", "o"), ("EXPLAIN", "scan")], "statement, found"))
def show_statements(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    plan = "\n".join(r[0] for r in s.query("EXPLAIN SELECT id FROM o WHERE id = 7").collect())
    copy = at.session(s.query("SHOW CREATE TABLE o").collect()[0]["create_table"])
    found = [("SHOW TABLES", s.query("SHOW TABLES").collect()[0]["table_name"]), ("SHOW INDEX", s.query("SHOW INDEX FROM o").collect()[0]["key_name"])]
    found += [("SHOW CREATE", copy.query("SHOW TABLES").collect()[0]["table_name"]), ("EXPLAIN", "scan" if "parquet" in plan.lower() else "none")]
    return at.rows(found, "statement string, found string")


_REFUSED = ["CREATE VIEW v AS SELECT 1", "TRUNCATE TABLE o", "REPLACE INTO o VALUES (1)", "SAVEPOINT a", "RENAME TABLE o TO p", "CREATE TRIGGER t", "CALL p()", "ALTER TABLE o DROP PRIMARY KEY", "CREATE TABLE n (v INT)"]


@scenario(values([(t, "DialectError") for t in _REFUSED], "statement, result"))
def rejected_statements(at: Place) -> DataFrame:
    s = at.session(ORDERS)
    return at.rows([(t, outcome(lambda t=t: s.execute(t))) for t in _REFUSED], "statement string, result string")


# -- definitions -------------------------------------------------------------------------------------------------------


@scenario(f"SELECT CAST(7 AS BIGINT) AS rating, id AS k, status, CAST(cents AS VARCHAR) AS price FROM ({_O}) o")
def alter_table(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    s.execute("ALTER TABLE o ADD COLUMN rating BIGINT NOT NULL DEFAULT 7 FIRST, DROP COLUMN customer")
    s.execute("ALTER TABLE o RENAME COLUMN id TO k")
    s.execute("ALTER TABLE o CHANGE cents price VARCHAR(20)")
    return s.query("SELECT * FROM o")


_INDEX = [("plain", "done"), ("unique with duplicates", "ConstraintError"), ("unique", "done"), ("same name", "DialectError"), ("insert of a taken value", "ConstraintError"), ("drop", "done"), ("insert after the drop", "done")]


@scenario(values(_INDEX, "statement, result"))
def create_index(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL, "CREATE TABLE u (id BIGINT PRIMARY KEY, v BIGINT)", "INSERT INTO u SELECT o_orderkey, o_orderkey FROM orders")
    texts = ["CREATE INDEX a ON o (customer)", "CREATE UNIQUE INDEX b ON o (customer)", "CREATE UNIQUE INDEX v ON u (v)", "CREATE INDEX v ON u (v)", "INSERT INTO u SELECT -1, max(v) FROM u", "DROP INDEX v ON u", "INSERT INTO u SELECT -1, max(v) FROM u"]
    return at.rows([(n, outcome(lambda t=t: s.execute(t))) for (n, _), t in zip(_INDEX, texts, strict=True)], "statement string, result string")


_CHECKS = [("violated by rows", "ConstraintError"), ("added", "done"), ("insert of a bad row", "ConstraintError"), ("update to a bad row", "ConstraintError"), ("unknown passes", "done"), ("dropped", "done"), ("insert after the drop", "done")]


@scenario(values(_CHECKS, "statement, result"))
def check_constraint(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    texts = [
        "ALTER TABLE o ADD CONSTRAINT low CHECK (cents < 1000)",
        "ALTER TABLE o ADD CONSTRAINT sane CHECK (cents >= 0 AND LENGTH(status) = 1)",
        "INSERT INTO o VALUES (-1, 1, 'F', -5)",
        "UPDATE o SET status = 'é' WHERE id = 1",
        "INSERT INTO o VALUES (-2, 1, NULL, 5)",
        "ALTER TABLE o DROP CHECK sane",
        "INSERT INTO o VALUES (-1, 1, 'F', -5)",
    ]
    return at.rows([(n, outcome(lambda t=t: s.execute(t))) for (n, _), t in zip(_CHECKS, texts, strict=True)], "statement string, result string")


@scenario("SELECT 'o' AS name, 'exists' AS result UNION ALL SELECT 'o', 'DialectError' UNION ALL SELECT 'o', 'done' UNION ALL SELECT 'o', 'gone'")
def create_drop_table(at: Place) -> DataFrame:
    s = at.session(ORDERS)
    have = lambda: [r["table_name"] for r in s.query("SHOW TABLES").collect()]
    found = [("o", "exists" if have() == ["o"] else "gone"), ("o", outcome(lambda: s.execute(ORDERS))), ("o", outcome(lambda: s.execute("DROP TABLE o")))]
    return at.rows([*found, ("o", "gone" if not have() else "exists")], "name string, result string")


# -- transactions ------------------------------------------------------------------------------------------------------


@scenario(f"SELECT id, customer, CASE WHEN id % 4 = 0 THEN 'mine' ELSE status END AS status, cents FROM ({_O}) o")
def transaction_rows(at: Place) -> DataFrame:
    """A committed transaction, one rolled back, and a statement of an open one that fails and undoes itself alone."""
    s = at.session(ORDERS, FILL)
    s.execute("BEGIN")
    s.execute("UPDATE o SET status = 'lost'")
    s.execute("ROLLBACK")
    s.execute("BEGIN")
    s.execute("UPDATE o SET status = 'mine' WHERE id % 4 = 0")
    if outcome(lambda: s.execute("INSERT INTO o SELECT id + 900000000, customer, status, cents FROM o UNION ALL SELECT min(id), 1, 'x', 1 FROM o")) != "ConstraintError":
        raise AssertionError("a taken key is an error")
    s.execute("COMMIT")
    return s.query("SELECT * FROM o")


@scenario(f"SELECT 'before' AS seen, id, cents FROM ({_O}) o UNION ALL SELECT 'own', id, cents + 1 FROM ({_O}) o WHERE id % 2 = 1")
def snapshot_in_transaction(at: Place) -> DataFrame:
    """What an open transaction reads while another commits, and then with edits of its own."""
    s = at.session(ORDERS, FILL)
    other = at.open(s.engine)
    s.execute("BEGIN")
    before = s.query("SELECT 'before' AS seen, id, cents FROM o")
    other.execute("DELETE FROM o WHERE id % 2 = 0")
    kept = s.query("SELECT 'before' AS seen, id, cents FROM o").exceptAll(before).count()
    if kept:
        raise AssertionError("an open transaction sees another's edits")
    s.execute("ROLLBACK")
    s.execute("BEGIN")
    s.execute("UPDATE o SET cents = cents + 1")
    own = s.query("SELECT 'own' AS seen, id, cents FROM o")
    s.execute("COMMIT")
    return before.unionByName(own)


_CLASHES = [("same row", "ConflictError"), ("other row", "done"), ("same unique value", "ConflictError"), ("table altered", "ConflictError"), ("version published", "ConflictError")]


@scenario(values([(n, r, "committed" if r == "done" else "rejected") for n, r in _CLASHES], "clash, result, outcome"))
def transaction_conflicts(at: Place) -> DataFrame:
    """The second of two transactions that were open together, and what is known of it later."""
    s = at.session(ORDERS, FILL, "CREATE UNIQUE INDEX u ON o (id, cents)", "CREATE TABLE v (id BIGINT PRIMARY KEY, x BIGINT, UNIQUE KEY ux (x))")
    other, found = at.open(s.engine), []
    pairs = [
        ("UPDATE o SET cents = 1 WHERE id = 1", "UPDATE o SET cents = 2 WHERE id <= 3"),
        ("UPDATE o SET cents = 3 WHERE id = 4", "UPDATE o SET cents = 4 WHERE id = 5"),
        ("INSERT INTO v VALUES (1, 10)", "INSERT INTO v VALUES (2, 10)"),
        ("ALTER TABLE v ADD COLUMN y INT", "INSERT INTO v (id, x) VALUES (3, 30)"),
        (None, "UPDATE o SET cents = 5 WHERE id = 6"),
    ]
    for (name, _), (first, second) in zip(_CLASHES, pairs, strict=True):
        s.execute("BEGIN")
        s.execute(second)
        other.execute(first) if first else s.engine.checkpoint()
        result = outcome(lambda: s.execute("COMMIT"))
        found.append((name, result, s.query(f"SELECT vellum_recover_commit('{s.last_transaction}') AS x").collect()[0]["x"]))
    return at.rows(found, "clash string, result string, outcome string")


@scenario(values([("committed", "committed"), ("rolled back", "unknown"), ("of nobody", "unknown"), ("checkpointed", "committed")], "which, outcome"))
def recover_outcome(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    first = s.last_transaction
    found = [("committed", s.engine.recover_commit(first))]
    lost = s.begin().id
    s.execute("DELETE FROM o")
    s.rollback()
    found += [("rolled back", s.engine.recover_commit(lost)), ("of nobody", s.engine.recover_commit("0" * 32))]
    s.engine.checkpoint()
    return at.rows([*found, ("checkpointed", s.engine.recover_commit(first))], "which string, outcome string")


# -- versions ----------------------------------------------------------------------------------------------------------

_EDITED = f"SELECT id, customer, CASE WHEN id % 5 = 0 THEN 'E' ELSE status END AS status, cents FROM ({_O}) o WHERE id % 7 <> 0"


def _edited(s: Session) -> None:
    s.execute("UPDATE o SET status = 'E' WHERE id % 5 = 0")
    s.execute("DELETE FROM o WHERE id % 7 = 0")


@scenario(f"SELECT 'first' AS version, * FROM ({_O}) a UNION ALL SELECT 'second', * FROM ({_EDITED}) b")
def checkpoint_versions(at: Place) -> DataFrame:
    """Two checkpoints, read at their versions after more edits."""
    s = at.session(ORDERS, FILL)
    first = s.engine.checkpoint("first")
    _edited(s)
    second = s.engine.checkpoint("second")
    s.execute("DELETE FROM o")
    read = lambda v, name: s.engine.table_at("o", v).select(F.lit(name).alias("version"), "*")
    return read(first, "first").unionByName(read(second, "second"))


@scenario(_EDITED)
def journal_replay(at: Place) -> DataFrame:
    """A store opened anew reads its journal."""
    s = at.session(ORDERS, FILL)
    _edited(s)
    again = open_engine(s.engine.store.root, at.spark, create=False)
    return again.session().query("SELECT * FROM o")


@scenario(_EDITED)
def audit_mode(at: Place) -> DataFrame:
    """A version a transaction: the last of three holds all."""
    s = at.session(ORDERS, FILL, mode="audit")
    _edited(s)
    if len(s.engine.store.ancestors(s.engine.store.head().id)) != 5 or s.engine.store.journal(s.engine.store.head().id):
        raise AssertionError("a transaction is a version")
    return s.engine.table_at("o", s.engine.store.head().id)


@scenario(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM ({_O}) o WHERE id % 7 = 0 OR (id % 5 = 0 AND status IS DISTINCT FROM 'E')")
def diff_versions(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    s.engine.checkpoint()
    _edited(s)
    return s.engine.diff_rows("o").select("id", "change")


@scenario(f"SELECT id, customer, CASE WHEN id % 4 = 0 THEN 'L' WHEN id % 6 = 1 THEN 'R' ELSE status END AS status, cents FROM ({_O}) o WHERE id % 10 <> 3")
def sync_merge(at: Place) -> DataFrame:
    """Two stores change other rows of one table and exchange them through a third."""
    a = at.session(ORDERS, FILL)
    a.engine.checkpoint()
    peer = folder(at.spark, "peer")
    sync.enable(a.engine, peer)
    sync.sync(a.engine)
    b = at.session()
    sync.enable(b.engine, peer)
    a.execute("UPDATE o SET status = 'L' WHERE id % 4 = 0 AND id % 10 <> 3")
    b.execute("UPDATE o SET status = 'R' WHERE id % 6 = 1 AND id % 10 <> 3")
    b.execute("DELETE FROM o WHERE id % 10 = 3")
    for s in (a, b):
        s.engine.checkpoint()
        sync.sync(s.engine)
    sync.sync(a.engine)
    return a.query("SELECT * FROM o")


@scenario(f"SELECT id, CASE WHEN id % 4 = 0 AND id % 6 = 0 THEN CASE WHEN id = 12 THEN 'R' ELSE 'L' END WHEN id % 4 = 0 THEN 'L' WHEN id % 6 = 0 THEN 'R' ELSE status END AS status FROM ({_O}) o WHERE id <= 40")
def sync_conflicts(at: Place) -> DataFrame:
    """Rows that both sides changed: each is a conflict, and resolved."""
    a = at.session(ORDERS, f"{FILL} WHERE o_orderkey <= 40")
    a.engine.checkpoint()
    peer = folder(at.spark, "peer")
    sync.enable(a.engine, peer)
    sync.sync(a.engine)
    b = at.session()
    sync.enable(b.engine, peer)
    a.execute("UPDATE o SET status = 'R' WHERE id % 6 = 0")
    b.execute("UPDATE o SET status = 'L' WHERE id % 4 = 0")
    for s in (a, b):
        s.engine.checkpoint()
    sync.sync(a.engine)
    state = sync.sync(b.engine)
    for c in state.conflicts:
        state = sync.resolve(b.engine, c["id"], "remote" if c["rows"]["l"]["id"] == 12 else "local")
    if state.state != "merged":
        raise AssertionError(f"resolved conflicts merge: {state.state}")
    return b.query("SELECT id, status FROM o")


@scenario(values([("as written", "ok"), ("after damage", "broken")], "state, found"))
def integrity_check(at: Place) -> DataFrame:
    s = at.session(ORDERS, FILL)
    s.engine.checkpoint()
    _edited(s)
    s.engine.checkpoint()
    found = [("as written", "ok" if check(s.engine, everything=True).ok else "broken")]
    name = s.engine.store.files_of(s.engine.store.head())[0]
    with open(s.engine.store.path(name), "r+b") as f:
        f.seek(40)
        f.write(b"\0\1\2\3")
    return at.rows([*found, ("after damage", "ok" if check(s.engine, everything=True).ok else "broken")], "state string, found string")


# -- files -------------------------------------------------------------------------------------------------------------

_KINDS = ["parquet", "orc", "csv", "json"]


@scenario(" UNION ALL ".join(f"SELECT '{k}' AS kind, c_custkey, c_name, c_mktsegment FROM customer" for k in _KINDS))
def file_formats(at: Place) -> DataFrame:
    """A table written and read in each format."""
    rows, out = at.spark.read.parquet(f"{at.sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"), None
    for kind in _KINDS:
        path = "file://" + folder(at.spark, kind)
        files.write(rows, path, kind)
        one = files.read(at.spark, path, kind, "c_custkey bigint, c_name string, c_mktsegment string").select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@scenario("SELECT c_custkey AS id, c_name AS name FROM customer")
def import_files(at: Place) -> DataFrame:
    s = at.session("CREATE TABLE c (id BIGINT PRIMARY KEY, name VARCHAR(40) NOT NULL)")
    files.import_table(s, "c", at.spark.read.parquet(f"{at.sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name"))
    return s.query("SELECT * FROM c")
