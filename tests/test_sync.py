import io
import json

import pytest

from vellum import sync as exchange
from vellum.check import check
from vellum.cli import main
from vellum.session import open_engine
from vellum.sources import files
from vellum.sources.store import Store, StoreError


def made(spark, path, *texts, mode="journal"):
    engine = open_engine(path, spark, mode, durability="off")
    s = engine.session()
    for t in texts:
        s.execute(t)
    return engine, s


def rows(engine, table="t"):
    return sorted(tuple(r) for r in engine.table_at(table).collect())


@pytest.fixture
def two(spark, tmp_path):
    a, sa = made(spark, tmp_path / "a", "CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(9))", "CREATE TABLE u (id BIGINT PRIMARY KEY, x INT, UNIQUE KEY ux (x))", "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    a.checkpoint()
    exchange.enable(a, tmp_path / "peer")
    assert exchange.sync(a).state in ("pushed", "merged")
    b, sb = made(spark, tmp_path / "b")
    exchange.enable(b, tmp_path / "peer")
    assert rows(b) == rows(a)
    return a, sa, b, sb


def test_merge_and_conflicts(two):
    a, sa, b, sb = two
    assert exchange.sync(a).state == "up-to-date"
    sa.execute("UPDATE t SET v = 'A' WHERE id = 1")
    sa.execute("UPDATE t SET v = 'mine' WHERE id = 3")
    with pytest.raises(StoreError):
        exchange.sync(a)
    a.checkpoint()
    assert exchange.sync(a).state == "pushed"
    sb.execute("INSERT INTO t VALUES (4, 'd')")
    sb.execute("UPDATE t SET v = 'theirs' WHERE id = 3")
    sb.execute("DELETE FROM t WHERE id = 2")
    b.checkpoint()
    got = exchange.sync(b)
    assert got.state == "conflicts" and len(got.conflicts) == 1 and got.conflicts[0]["rows"]["l"]["v"] == "theirs"
    assert exchange.conflicts(b.store) == got.conflicts
    done = exchange.resolve(b, got.conflicts[0]["id"], "remote")
    assert done.state == "merged"
    assert exchange.sync(a).state == "fast-forward"
    assert rows(a) == rows(b) == [(1, "A"), (3, "mine"), (4, "d")]
    assert len(a.store.head().parents) == 2 and check(a, everything=True).ok


def test_merge_that_breaks_a_key(two):
    a, sa, b, sb = two
    sa.execute("INSERT INTO u VALUES (1, 7)")
    a.checkpoint()
    exchange.sync(a)
    sb.execute("INSERT INTO u VALUES (2, 7)")
    b.checkpoint()
    with pytest.raises(exchange.MergeInvalid):
        exchange.sync(b)


def test_schema_conflict(two):
    a, sa, b, sb = two
    sa.execute("ALTER TABLE t ADD COLUMN n INT")
    a.checkpoint()
    exchange.sync(a)
    sb.execute("ALTER TABLE t MODIFY v VARCHAR(50)")
    b.checkpoint()
    assert [c["id"] for c in exchange.sync(b).conflicts] == ["schema:t"]
    assert exchange.resolve(b, "schema:t", "local").state == "merged"
    assert b.table_at("t").columns == ["id", "v"]


def test_check_finds_damage(spark, tmp_path):
    e, s = made(spark, tmp_path / "d", "CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)", "INSERT INTO t VALUES (1, 1), (2, 2)")
    e.checkpoint()
    assert check(e).ok
    f = e.store.root / e.store.files_of(e.store.head())[0]
    held = f.read_bytes()
    f.write_bytes(held[:-1] + b"?")
    assert any("digest" in p for p in check(e).problems)
    f.unlink()
    assert any("missing" in p for p in check(e).problems)
    f.write_bytes(held)
    s.execute("INSERT INTO t VALUES (3, 3)")
    entry = next((e.store.root / "_journal" / e.store.ref("data")).glob("*.json"))
    body = json.loads(entry.read_text())
    body["body"]["tx"] = "forged"
    entry.write_text(json.dumps(body))
    assert any("damaged" in p for p in check(e).problems)
    with pytest.raises(StoreError):
        Store.open(tmp_path / "nowhere")


def test_command_line_and_import(spark, tmp_path):
    def run(*args):
        out = io.StringIO()
        code = main(["--store", str(tmp_path / "c"), "--durability", "off", *args], spark, out)
        return code, out.getvalue()

    assert run("init")[0] == 0
    assert run("sql", "CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(9));\nINSERT INTO t VALUES (1, 'x');\nSELECT * FROM t")[1].endswith("id\tv\n1\tx\n")
    assert "added t" in run("status")[1]
    run("commit", "-m", "first")
    run("sql", "UPDATE t SET v = 'y'")
    assert "modified" in run("diff", "t")[1]
    assert run("check", "--all")[0] == 0
    engine = open_engine(tmp_path / "c", spark, durability="off")
    path = str(tmp_path / "rows.csv")
    files.write(spark.createDataFrame([(5, "q"), (6, "r")], "id bigint, v string"), path, "csv")
    assert files.import_table(engine.session(), "t", files.read(spark, path, "csv", "id bigint, v string")) == 2
    assert rows(engine) == [(1, "y"), (5, "q"), (6, "r")]
    assert engine.store.vacuum() > 0 and rows(engine) == [(1, "y"), (5, "q"), (6, "r")]


def test_changes_as_a_stream(spark, tmp_path):
    from vellum.streaming import changes

    e, s = made(spark, tmp_path / "s", "CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)", "INSERT INTO t VALUES (1, 1), (2, 2)")
    e.checkpoint()
    base = e.table_at("t")
    s.execute("UPDATE t SET v = 9 WHERE id = 1")
    s.execute("DELETE FROM t WHERE id = 2")
    seen = []
    q = changes.stream(e, "t").writeStream.foreachBatch(changes.fold(e, "t", base, lambda df, n: seen.append(sorted(tuple(r) for r in df.collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen[-1] == [(1, 9)]


def test_a_strict_merge_reads_checks_of_the_dialect(two):
    a, sa, b, sb = two
    sa.execute("CREATE TABLE j (id BIGINT PRIMARY KEY, doc JSON, CHECK (JSON_EXTRACT(doc, '$.n') < 5))")
    sa.execute("INSERT INTO j VALUES (1, '{\"n\": 1}'), (2, '{\"n\": 2}')")
    a.checkpoint()
    base = a.store.ref("data")
    sa.execute("UPDATE j SET doc = '{\"n\": 3}' WHERE id = 1")
    ours = a.checkpoint()
    with a.store.lock():
        a.store.set_ref("data", base)
    sa.execute("UPDATE j SET doc = '{\"n\": 4}' WHERE id = 2")
    theirs = a.checkpoint()
    with a.store.lock():
        a.store.set_ref("data", ours)
    assert exchange.merge_versions(a, ours, theirs, {}, strict=True).state == "merged"
    assert rows(a, "j") == [(1, '{"n":3}'), (2, '{"n":4}')]
