"""Every query of the suite against DuckDB on the smallest tables, and the shape of some plans."""

import decimal

import duckdb
import pytest

from vellum import scenarios, suite
from vellum.operators import constraints, merge, overlay

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in suite.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.9g}"
    return str(v) if v is not None and not isinstance(v, bool | int | str) or isinstance(v, decimal.Decimal) else v


QUERIES, ORACLES = suite.QUERIES | scenarios.QUERIES, suite.ORACLES | scenarios.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got or name in ("point_miss", "point_read")  # the key of point_read is in larger tables alone
    assert got == sorted([[plain(r[i]) for i in at] for r in want.fetchall()], key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(suite.QUERIES["point_read"](spark, SF))
    assert "EqualTo(o_orderkey,4200)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "ReadSchema: struct<>" in plan(suite.QUERIES["count_star"](spark, SF))
    assert "TakeOrderedAndProject" in plan(suite.QUERIES["ordered_limit_desc"](spark, SF))


def test_merge_tells_null_rows_from_absent_ones(spark):
    schema = "k int, v string"
    base, local, remote = (spark.createDataFrame(rows, schema) for rows in ([(1, None), (2, "b")], [(1, None), (2, None)], [(2, "b")]))
    assert [tuple(r) for r in merge.three_way(base, local, remote, ["k"]).collect()] == [(2, None)]
    assert merge.conflicts(base, local, remote, ["k"]).count() == 0


def test_content_hash_tells_places_of_nulls(spark):
    a, b = (spark.createDataFrame([r], "x int, y int") for r in ((1, None), (None, 1)))
    assert merge.content_hash(a).collect() != merge.content_hash(b).collect()


def test_overlay_of_random_edits(spark):
    import random

    rng, model = random.Random(4), {}
    base = spark.createDataFrame([(k, 0) for k in range(20)], "k int, v int")
    model = {k: 0 for k in range(20)}
    edits = []
    for g in range(1, 60):
        k = rng.randrange(30)
        if rng.random() < 0.3:
            edits.append((k, None, "del", g, 0))
            model.pop(k, None)
        else:
            edits.append((k, g, "put", g, 0))
            model[k] = g
    e = spark.createDataFrame(edits, "k int, v int, _op string, _generation long, _seq long")
    assert {r["k"]: r["v"] for r in overlay.overlay(base, e, ["k"]).collect()} == model


def test_unique_ignores_nulls_and_checks_pass_unknowns(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5)], "k int, u int")
    assert [tuple(r) for r in constraints.unique_violations(df, ["u"]).collect()] == [(5, 2)]
    assert constraints.check_violations(df, "u > 5").count() == 2


@pytest.mark.parametrize(("name", "source"), [("secondary_order_desc", "orders"), ("order_multi", "part"), ("enum_order", "orders"), ("null_order", "orders")])
def test_whole_tables_are_ordered(spark, db, name, source):
    got = [tuple(r) for r in suite.QUERIES[name](spark, SF).collect()]
    assert got == db.sql(suite.ORACLES[name]).fetchall()
    assert [(len(got),)] == db.sql(f"SELECT count(*) FROM {source}").fetchall()


def test_whole_tables_are_joined_ranked_and_computed(spark, db):
    rows = lambda t: db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0]
    joined = suite.QUERIES["join_full"](spark, SF).collect()
    left, right = ([r[c] for r in joined if r[c] is not None] for c in ("p_partkey", "c_custkey"))
    assert len(left) == rows("part") < len(joined) and len(right) == rows("customer") < len(joined)
    assert suite.QUERIES["win_distribution"](spark, SF).count() == rows("part")
    assert suite.QUERIES["decimal_arith"](spark, SF).count() == rows("lineitem")


def joined(node):
    """Rows that the joins of a plan that ran have made."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined(node.plan())
    own = node.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
    return own + sum(joined(node.children().apply(i)) for i in range(node.children().size()))


def test_a_self_join_is_counted_without_its_pairs(spark, tmp_path):
    """A group of many, groups of one, keys with several rows and in several groups, nulls."""
    odd = [(k, 7) for k in range(1500)] + [(5, 7), (5, 8), (6, 8), (6, 8), (9000, 9), (9001, 10), (9001, 10), (None, 7), (None, None), (9002, None), (3, -1), (None, -1)]
    spark.createDataFrame(odd, "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    df = suite.QUERIES["join_self"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(con.sql(suite.ORACLES["join_self"]).fetchall()) and len(got) == 1500
    assert df.dtypes == [("a", "bigint"), ("n", "bigint")]
    assert joined(df._jdf.queryExecution().executedPlan()) <= len(odd)
