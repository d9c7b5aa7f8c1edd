import pytest

from vellum import session
from vellum.server import Client, Server, ServerError
from vellum.session import Engine, open_engine
from vellum.sources.store import Store, copy_file


@pytest.fixture
def server(spark, tmp_path):
    made = Server(open_engine(tmp_path / "db", spark, durability="full")).start()
    yield made
    made.close()


def test_sessions_over_a_port(server):
    a, b = (Client("127.0.0.1", server.port, 120) for _ in range(2))
    assert a.ping() == server.engine.store.ref("data")
    a.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(9), at TIME)")
    assert a.execute("INSERT INTO t VALUES (1, ?, '01:02:03'), (2, NULL, NULL)", ["é"]) == 2
    assert b.query("SELECT * FROM t ORDER BY id") == [("1", "é", "01:02:03"), ("2", None, None)] and b.columns == ["id", "v", "at"]
    a.execute("BEGIN")
    a.execute("DELETE FROM t")
    assert a.query("SELECT id FROM t") == [] and len(b.query("SELECT id FROM t")) == 2
    a.close()
    with pytest.raises(ServerError, match="ConstraintError: duplicate"):
        b.execute("INSERT INTO t VALUES (1, 'x', NULL)")
    with pytest.raises(ServerError, match="DialectError"):
        b.query("SELEC")
    assert b.query("SELECT count(*) FROM t") == [("2",)]
    server.read_only = True
    with pytest.raises(ServerError, match="read only"):
        b.execute("DELETE FROM t")
    b.close()


def test_work_is_counted(spark):
    engine = Engine(Store.temporary(), spark)
    s = engine.session()
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    before = engine.work.copy()
    s.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    s.query("SELECT * FROM t").collect()
    engine.checkpoint()
    done = engine.work.since(before)
    assert (done.statements, done.queries, done.rows_changed, done.commits, done.checkpoints, done.conflicts) == (1, 1, 2, 1, 1, 0)
    assert done.files_written >= 2


def test_the_journal_is_bounded(spark, tmp_path):
    engine = open_engine(tmp_path / "db", spark, durability="off")
    s = engine.session()
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    made = []
    for i in range(4):
        s.execute("INSERT INTO t VALUES (?, 0)", [i])
        made.append(s.last_transaction)
        engine.checkpoint()
    assert len(list((tmp_path / "db" / "_journal").iterdir())) == 2
    assert {engine.recover_commit(t) for t in made} == {"committed"} and engine.recover_commit("ab") == "unknown"
    other = Store.init(tmp_path / "other", "off")
    other.copy_from(engine.store, engine.store.ref("data"))
    other.set_ref("data", engine.store.ref("data"))
    assert other.outcome(made[0]) == "committed"


def test_many_files_are_copied_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "DISTRIBUTED_COPIES", 2)
    engine = open_engine(tmp_path / "db", spark, durability="off")
    pairs = []
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(str(i))
        pairs.append((str(tmp_path / f"{i}.txt"), str(tmp_path / "to" / f"{i % 2}" / f"{i}.txt")))
    engine.store.copier(pairs)
    assert [open(b).read() for _, b in pairs] == list("01234")
    copy_file(pairs[0][0], pairs[1][1])
    assert open(pairs[1][1]).read() == "0"
