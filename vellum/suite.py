"""The driver's queries: one for each operator of the inventory, with its SQL for an outside engine.

Reads are SQL text over views (Catalyst plans them); mutations, constraints, differences and merges call vellum.operators.
Base, local and remote sides and edits are made from keys by arithmetic, so that SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import dialect
from vellum.operators import constraints, ddl, dml, merge, overlay, selfjoin

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query given as SQL; {table} stands for a table. oracle: where the other engine's dialect differs."""
    used = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dialect.register(spark)
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    oracle = oracle or text
    for t in TABLES:
        oracle = oracle.replace("{" + t + "}", t)
    ORACLES[name] = oracle


def frame(oracle: str):
    """Registers a query given as a function of (spark, tables), where tables(name) reads a table."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: table(spark, sf_dir, name))
        ORACLES[f.__name__] = oracle
        return f

    return keep


# -- scans and access paths --------------------------------------------------------------------------------------------

sql("scan_full", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}")
sql("project_subset", "SELECT o_orderpriority AS priority, o_orderkey AS id FROM {orders}")
sql("project_repeat", "SELECT o_orderkey AS id, o_orderstatus AS s1, o_orderstatus AS s2, o_orderkey + 100 AS id_plus FROM {orders}")
sql("count_star", "SELECT count(*) AS n FROM {lineitem}")
sql("literal_row", "SELECT 1 AS one, 'a' AS a")
sql("point_read", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 4200")
sql("point_miss", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = -1")
sql("pk_in", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey IN (7, 3, 7, 99, 500, -4)")
sql("range_100", "SELECT event_id, event_type, value FROM {events} WHERE event_id >= 300 AND event_id < 400")
sql("multi_range", "SELECT event_id FROM {events} WHERE event_id BETWEEN 10 AND 60 OR event_id BETWEEN 40 AND 90 OR event_id > 900 AND event_id <= 905")
sql("range_extremes", "SELECT event_id FROM {events} WHERE event_id > 9223372036854775807 OR event_id < -9223372036854775807 OR event_id <= 2")
sql("composite_prefix_range", "SELECT conv_id, turn, role FROM {conversations} WHERE conv_id = 2 AND turn >= 1 AND turn < 4")
sql("secondary_eq", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
sql("secondary_range", "SELECT user_id, event_id FROM {events} WHERE user_id >= 5 AND user_id < 20")
sql("is_null", "SELECT k FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS s FROM {orders}) t WHERE s IS NULL")
sql("is_not_null", "SELECT k, s FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS s FROM {orders}) t WHERE s IS NOT NULL")

# -- predicates --------------------------------------------------------------------------------------------------------

sql("cmp_all", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM {part}")
sql("bool_logic", "SELECT p_partkey FROM {part} WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' AND p_size = 1)")
sql("in_subquery_limit", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM (SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 20 OFFSET 5) t)")
sql("exists_corr", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})")
sql(
    "regexp_filter",
    "SELECT p_partkey, p_name FROM {part} WHERE p_name RLIKE '^[a-m].*[0-9a-z]$'",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-9a-z]$')",
)
sql("like_filter", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%A%' AND p_brand LIKE 'Brand#_2'")
sql("implicit_compare", "SELECT o_orderkey FROM {orders} WHERE o_orderdate > '1996-06-15'")
sql(
    "ci_filter",
    "SELECT c_custkey FROM {customer} WHERE c_mktsegment COLLATE UTF8_LCASE = 'buiLDing'",
    "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
)
sql(
    "null_safe_eq",
    "SELECT k FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS s FROM {orders}) t WHERE s <=> NULL",
    "SELECT k FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS s FROM orders) t WHERE s IS NOT DISTINCT FROM NULL",
)

# -- joins -------------------------------------------------------------------------------------------------------------

sql("join_aggregate", "SELECT c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment")
sql("join_constant", "SELECT n_name, count(*) AS n FROM {orders} JOIN {nation} ON n_nationkey = 1 GROUP BY n_name")
sql("join_inner", "SELECT l_orderkey, l_linenumber, s_name FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_quantity > 45")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql("join_right", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM {labels} l RIGHT JOIN {documents} d ON d.doc_id = l.doc_id")
sql("join_full", "SELECT p_partkey, c_custkey FROM {part} FULL JOIN {customer} ON c_custkey = 2 * p_partkey")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
sql(
    "join_anti",
    "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 1000 * c_nationkey",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 1000 * c_nationkey)",
)
sql("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_name > b.n_name")


@frame("SELECT a.c_custkey AS a, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY a.c_custkey")
def join_self(spark, t):
    """A nation's pairs are the square of its customers, so they are counted by its size."""
    return selfjoin.others_in_group(t("customer"), "c_custkey", "c_nationkey", "a", "n")


sql(
    "join_multiway",
    "SELECT r_name, count(*) AS n FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name",
)

# -- aggregates --------------------------------------------------------------------------------------------------------

sql("kind_count", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
sql("status_count", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
sql("checksum_agg", "SELECT CAST(sum(user_id) AS BIGINT) AS s, max(event_id) AS m, CAST(sum(length(props)) AS BIGINT) AS chars FROM {events}")
sql(
    "agg_basic",
    "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_tax) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, CAST(round(avg(l_linenumber), 6) AS DOUBLE) AS mean FROM {lineitem} GROUP BY l_returnflag",
)
sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
sql("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("group_by_expr", "SELECT o_orderkey % 10 AS bucket, count(*) AS n FROM {orders} GROUP BY o_orderkey % 10")
sql(
    "ci_group",
    "SELECT lower(min(s)) COLLATE UTF8_BINARY AS s, count(*) AS n FROM (SELECT (CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END) COLLATE UTF8_LCASE AS s FROM {orders}) t GROUP BY s",
    "SELECT lower(o_orderpriority) AS s, count(*) AS n FROM orders GROUP BY 1",
)
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql(
    "string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)

# -- windows -----------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
sql(
    "win_rank",
    f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr, CAST(ntile(3) {_W} AS BIGINT) AS tile FROM {{orders}}",
)
sql("win_running_sum", "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM {events}")
sql(
    "win_lag",
    "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS later, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first_id FROM {events}",
)
sql("win_nth_value", "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS quarter FROM {events}")
sql(
    "win_frame",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS top FROM {events}",
)
sql(
    "win_distribution",
    "SELECT p_partkey, CAST(round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_partkey) * 1000000) AS BIGINT) AS pr, CAST(round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_partkey) * 1000000) AS BIGINT) AS cd FROM {part}",
)

# -- order and limit ---------------------------------------------------------------------------------------------------

sql("ordered_limit_desc", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey DESC LIMIT 50")
sql("limit_offset", "SELECT event_id FROM {events} ORDER BY event_id LIMIT 25 OFFSET 40")
sql("board_top50", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 50")
sql("events_recent", "SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100")
sql("events_session", "SELECT event_id, ts, event_type FROM {events} WHERE user_id = 7 ORDER BY ts, event_id")
sql("secondary_order_desc", "SELECT o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey DESC, o_orderkey DESC")
sql("order_multi", "SELECT p_partkey, p_brand, p_size FROM {part} ORDER BY p_brand, p_size DESC, p_partkey")
sql(
    "enum_order",
    "SELECT o_orderkey, o_orderstatus FROM {orders} ORDER BY array_position(array('P', 'O', 'F'), o_orderstatus), o_orderkey",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY list_position(['P', 'O', 'F'], o_orderstatus), o_orderkey",
)
sql("null_order", "SELECT s, k FROM (SELECT nullif(o_orderstatus, 'O') AS s, o_orderkey AS k FROM {orders}) t ORDER BY s NULLS FIRST, k")

# -- set operations ----------------------------------------------------------------------------------------------------

sql("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
sql("set_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
sql("set_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_custkey % 2 = 0")
sql("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
sql("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m")
sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")

# -- functions ---------------------------------------------------------------------------------------------------------

sql(
    "json_extract",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_unquote(json_extract(props, '$.k')) AS text FROM {events}",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS text FROM events",
)
sql(
    "json_object",
    "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS doc FROM {nation}",
    "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS doc FROM nation",
)
sql(
    "string_funcs",
    "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 2, 3) AS s, concat(p_brand, '-', p_type) AS c, replace(p_type, 'A', '#') AS r, trim(concat('  ', p_brand, ' ')) AS t, reverse(p_brand) AS b FROM {part}",
)
sql(
    "date_funcs",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, o_orderdate + INTERVAL 1 DAY AS later, CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM {orders}",
)
sql(
    "math_funcs",
    "SELECT p_partkey, abs(p_size - 25) AS a, CAST(p_size % 7 AS INT) AS m, CAST(floor(p_size / 4.0) AS BIGINT) AS f, CAST(ceil(p_size / 4.0) AS BIGINT) AS c, CAST(round(sqrt(p_size) * 1000) AS BIGINT) AS q, greatest(p_size, 20) AS g, CAST(power(2, p_size % 5) AS BIGINT) AS p FROM {part}",
)
sql(
    "decimal_arith",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(10,3)) AS DECIMAL(21,5)) AS prod, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - CAST(l_discount AS DECIMAL(12,2)) AS DECIMAL(13,2)) AS diff FROM {lineitem}",
)
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM {orders}")
sql(
    "regexp_funcs",
    "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'N') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x FROM {part}",
    "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x FROM part",
)
sql("cast_text", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR(20)) AS price, CAST(p_size AS VARCHAR(20)) AS size FROM {part}")

# -- overlay and data changes ------------------------------------------------------------------------------------------

_EDITS = """
    SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + g AS o_totalprice, o_orderdate, o_orderpriority,
           CASE WHEN (o_orderkey + g) % 5 = 0 THEN 'del' ELSE 'put' END AS op, g, o_orderkey % 4 AS s
    FROM orders, (SELECT unnest([1, 2, 3]) AS g) t WHERE o_orderkey % (g + 4) = 0"""
_LAST = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY g DESC, s DESC) AS rn FROM ({_EDITS}) e) x WHERE rn = 1"


def _edits(orders: DataFrame) -> DataFrame:
    made = orders.withColumn("_generation", F.explode(F.array(*[F.lit(g).cast("long") for g in (1, 2, 3)]))).where("o_orderkey % (_generation + 4) = 0")
    made = made.withColumn("_op", F.when((F.col("o_orderkey") + F.col("_generation")) % 5 == 0, "del").otherwise("put"))
    made = made.withColumn("o_totalprice", F.col("o_totalprice") + F.col("_generation")).withColumn("o_orderstatus", F.lit("X"))
    return made.withColumn("_seq", F.col("o_orderkey") % 4)


@frame(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_LAST}) n) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM ({_LAST}) m WHERE op = 'put'")
def overlay_read(spark, t):
    return overlay.overlay(t("orders"), _edits(t("orders")), ["o_orderkey"])


@frame(f"SELECT o_orderkey, op, CAST(g AS BIGINT) AS generation, o_totalprice FROM ({_LAST}) n")
def latest_per_key(spark, t):
    newest = overlay.latest_per_key(_edits(t("orders")), ["o_orderkey"])
    return newest.select("o_orderkey", F.col("_op").alias("op"), F.col("_generation").alias("generation"), "o_totalprice")


_NEW = "SELECT c_custkey + 1000000 AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0"


@frame(f"SELECT * FROM customer UNION ALL {_NEW}")
def dml_insert_result(spark, t):
    return dml.insert(t("customer"), t("customer").where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


@frame("SELECT * FROM nation UNION ALL SELECT CAST(100 + r_regionkey AS INT), r_name, r_regionkey FROM region")
def dml_insert_select(spark, t):
    rows = t("region").select((F.lit(100) + F.col("r_regionkey")).cast("int").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return dml.insert(t("nation"), rows)


_SHIFTED = "SELECT c_custkey + 100 AS c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer"


def _shifted(customer: DataFrame) -> DataFrame:
    return customer.select((F.col("c_custkey") + 100).alias("c_custkey"), F.upper("c_name").alias("c_name"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))


@frame(f"SELECT * FROM customer UNION ALL SELECT * FROM ({_SHIFTED}) s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_insert_ignore(spark, t):
    return dml.insert_ignore(t("customer"), _shifted(t("customer")), ["c_custkey"], ["c_name"])


@frame(
    f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE o.c_acctbal + n.c_acctbal END AS c_acctbal, CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment FROM customer o FULL JOIN ({_SHIFTED}) n ON o.c_custkey = n.c_custkey"
)
def dml_upsert_result(spark, t):
    return dml.upsert(t("customer"), _shifted(t("customer")), ["c_custkey"], {"c_acctbal": "c_acctbal + new.c_acctbal", "c_mktsegment": "new.c_mktsegment"})


@frame("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def dml_update_result(spark, t):
    return dml.update(t("orders"), "o_orderkey % 7 = 0", {"o_orderstatus": "'U'", "o_totalprice": "o_totalprice * 2"})


@frame("SELECT CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 5000000 ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dml_update_pk(spark, t):
    key = ["c_custkey"]
    pairs = dml.update_pairs(t("customer"), "c_custkey % 9 = 0", {"c_custkey": "c_custkey + 5000000"})
    gone = overlay.deletions(pairs.select("old.c_custkey"), t("customer"), key, 1, 0)
    put = overlay.as_edits(pairs.select("new.*"), "put", 1, 1)
    return overlay.overlay(t("customer"), gone.unionByName(put), key)


@frame("SELECT * FROM orders WHERE o_orderkey % 3 <> 0")
def dml_delete_result(spark, t):
    return dml.delete(t("orders"), "o_orderkey % 3 = 0")


@frame("SELECT n_nationkey, n_name, 'unknown' AS note, CAST((2 + 2) / 2 AS BIGINT) AS score FROM nation")
def dml_default(spark, t):
    rows = t("nation").select("n_nationkey", "n_name")
    return dml.with_defaults(rows, {"note": "'unknown'", "score": "(2 + 2) / 2"}, ["n_nationkey", "n_name", "note", "score"], {"note": "string", "score": "bigint"})


# -- data definition ---------------------------------------------------------------------------------------------------


@frame("SELECT c_custkey, CAST(7 AS BIGINT) AS rating, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def ddl_add_column(spark, t):
    return ddl.add_column(t("customer"), "rating", "bigint", "7", after="c_custkey")


@frame("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def ddl_drop_column(spark, t):
    return ddl.drop_column(t("customer"), "c_acctbal")


@frame("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice FROM part")
def ddl_modify_cast(spark, t):
    return ddl.modify_column(ddl.modify_column(t("part"), "p_size", "bigint"), "p_retailprice", "decimal(12,2)")


@frame("SELECT r_regionkey AS id, r_name FROM region")
def ddl_rename(spark, t):
    return ddl.rename_column(t("region"), "r_regionkey", "id")


# -- constraints -------------------------------------------------------------------------------------------------------


@frame("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, t):
    return constraints.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@frame("SELECT s, c, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'O') AS s, o_custkey AS c FROM orders) t WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY s, c HAVING count(*) > 1")
def unique_violations(spark, t):
    return constraints.unique_violations(t("orders").selectExpr("nullif(o_orderstatus, 'O') AS s", "o_custkey AS c"), ["s", "c"])


@frame("SELECT k, v FROM (SELECT c_custkey AS k, nullif(c_acctbal, 0) AS v FROM customer) t WHERE NOT (v >= 0)")
def check_violations(spark, t):
    return constraints.check_violations(t("customer").selectExpr("c_custkey AS k", "nullif(c_acctbal, 0) AS v"), "v >= 0")


@frame("SELECT k, s FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS s FROM orders) t WHERE s IS NULL")
def not_null_violations(spark, t):
    return constraints.null_keys(t("orders").selectExpr("o_orderkey AS k", "nullif(o_orderstatus, 'P') AS s"), ["s"])


# -- differences and merges --------------------------------------------------------------------------------------------

_COLS = "o_orderkey AS k, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS p"
_BASE = f"SELECT {_COLS} FROM orders WHERE o_orderkey % 11 <> 0"
_LOCAL = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 13 <> 0 AND (o_orderkey % 11 <> 0 OR o_orderkey % 2 = 0)"
_REMOTE = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 0 END AS p FROM orders WHERE o_orderkey % 17 <> 0 AND (o_orderkey % 11 <> 0 OR o_orderkey % 3 = 0)"
_SIDES = f"""
    SELECT coalesce(b.k, l.k, r.k) AS k, b.k AS bk, b.s AS bs, b.p AS bp, l.k AS lk, l.s AS ls, l.p AS lp, r.k AS rk, r.s AS rs, r.p AS rp,
        CASE WHEN l.k IS NOT DISTINCT FROM r.k AND l.s IS NOT DISTINCT FROM r.s AND l.p IS NOT DISTINCT FROM r.p THEN 'local'
             WHEN l.k IS NOT DISTINCT FROM b.k AND l.s IS NOT DISTINCT FROM b.s AND l.p IS NOT DISTINCT FROM b.p THEN 'remote'
             WHEN r.k IS NOT DISTINCT FROM b.k AND r.s IS NOT DISTINCT FROM b.s AND r.p IS NOT DISTINCT FROM b.p THEN 'local' ELSE 'conflict' END AS outcome
    FROM ({_BASE}) b FULL JOIN ({_LOCAL}) l ON b.k = l.k FULL JOIN ({_REMOTE}) r ON coalesce(b.k, l.k) = r.k"""


def _sides(spark, t) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=t("orders")) for q in (_BASE, _LOCAL, _REMOTE))


@frame(f"SELECT CASE WHEN outcome = 'local' THEN lk ELSE rk END AS k, CASE WHEN outcome = 'local' THEN ls ELSE rs END AS s, CASE WHEN outcome = 'local' THEN lp ELSE rp END AS p FROM ({_SIDES}) x WHERE outcome <> 'conflict' AND CASE WHEN outcome = 'local' THEN lk ELSE rk END IS NOT NULL")
def merge_three_way(spark, t):
    return merge.three_way(*_sides(spark, t), ["k"])


@frame(f"SELECT k, bs, bp, ls, lp, rs, rp FROM ({_SIDES}) x WHERE outcome = 'conflict'")
def merge_conflicts(spark, t):
    found = merge.conflicts(*_sides(spark, t), ["k"])
    return found.selectExpr("k", "b.s AS bs", "b.p AS bp", "l.s AS ls", "l.p AS lp", "r.s AS rs", "r.p AS rp")


_TAKE = "CASE WHEN outcome <> 'conflict' THEN outcome WHEN k % 4 = 0 THEN 'local' WHEN k % 4 = 1 THEN 'remote' WHEN k % 4 = 2 THEN 'base' ELSE 'delete' END"


@frame(
    f"SELECT CASE take WHEN 'local' THEN lk WHEN 'remote' THEN rk WHEN 'base' THEN bk END AS k, CASE take WHEN 'local' THEN ls WHEN 'remote' THEN rs WHEN 'base' THEN bs END AS s, CASE take WHEN 'local' THEN lp WHEN 'remote' THEN rp WHEN 'base' THEN bp END AS p FROM (SELECT *, {_TAKE} AS take FROM ({_SIDES}) x) y WHERE CASE take WHEN 'local' THEN lk WHEN 'remote' THEN rk WHEN 'base' THEN bk END IS NOT NULL"
)
def merge_resolved(spark, t):
    sides = _sides(spark, t)
    choice = merge.conflicts(*sides, ["k"]).selectExpr("k", "CASE WHEN k % 4 = 0 THEN 'local' WHEN k % 4 = 1 THEN 'remote' WHEN k % 4 = 2 THEN 'base' ELSE 'delete' END AS resolution")
    return merge.resolved(*sides, ["k"], choice)


@frame(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.p AS old_p, n.p AS new_p FROM ({_BASE}) o FULL JOIN ({_LOCAL}) n ON o.k = n.k WHERE o.k IS DISTINCT FROM n.k OR o.s IS DISTINCT FROM n.s OR o.p IS DISTINCT FROM n.p")
def diff_rows(spark, t):
    base, local, _ = _sides(spark, t)
    return merge.diff_rows(base, local, ["k"]).selectExpr("k", "change", "old.p AS old_p", "new.p AS new_p")


@frame("SELECT 'nation' AS table_name, 'unchanged' AS change UNION ALL SELECT 'orders', 'modified'")
def diff_tables(spark, t):
    base, local, _ = _sides(spark, t)
    out = None
    for name, old, new in (("nation", t("nation"), t("nation")), ("orders", base, local)):
        a, b = merge.content_hash(old), merge.content_hash(new)
        same = a.join(b, a.columns)  # both have one row
        one = same.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.when(F.col("n") > 0, "unchanged").otherwise("modified").alias("change"))
        out = one if out is None else out.unionByName(one)
    return out
