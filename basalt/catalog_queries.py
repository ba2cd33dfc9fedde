"""Queries over the test tables, by operator family; each has DuckDB SQL with the same columns where SQL can say it.

Sums of money go through exact decimals, so that results do not depend on the order of addition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalar
from .operators import aggregates as agg
from .operators import joins
from .operators.ordering import pg_order, top_k, top_k_per_group
from .operators.predicates import all_of, any_of, negate, where
from .plans import profile
from .plans.cache import ResultCache
from .registry import register
from .sources import formats
from .sources.snapshots import SnapshotTable
from .sources.workspace import workspace
from .streaming import windows


def statement(name: str, text: str, oracle: str | None = None, args: dict | list | None = None) -> None:
    """Register a statement that Spark and, unless told otherwise, DuckDB run as it stands."""

    @register(name, oracle or text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, sf_dir).sql(text, args)


def rows(name: str, table: str, oracle: str):
    """Register a function of one table."""

    def add(f):
        @register(name, oracle)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Engine(spark, sf_dir).table(table))

        return f

    return add


#: The test tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
AVG = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({0})"


# --- scans, sources, sinks -------------------------------------------------------------------------

statement("scan_all", "SELECT * FROM region")
statement("project_cols", "SELECT n_name, n_regionkey FROM nation")
statement("literal_row", "SELECT CAST(1 AS BIGINT) AS i, 'x' AS s, CAST(2.5 AS DOUBLE) AS d")
statement("literal_beside_column", "SELECT c_custkey, 'vip' AS tag, 7 AS n FROM customer")
statement("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
statement("session_constants", "SELECT 'default' AS current_db, version() IS NOT NULL AS has_version FROM region WHERE r_regionkey = 0")


@register("sql_named_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def sql_named_params(spark, sf_dir):
    text = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least"
    return Engine(spark, sf_dir).sql(text, {"status": "F", "least": 100000})


@register("sql_positional_params", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'O''Brien \" $10'")
def sql_positional_params(spark, sf_dir):
    return Engine(spark, sf_dir).sql("SELECT c_custkey FROM customer WHERE c_mktsegment = ? OR c_name = ?", ["BUILDING", "O'Brien \" $10"])


@register("parquet_roundtrip", "SELECT * FROM supplier")
def parquet_roundtrip(spark, sf_dir):
    path = formats.write(Engine(spark, sf_dir).table("supplier"), workspace(spark, "supplier"))
    return formats.read(spark, path)


@register("csv_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_source(spark, sf_dir):
    nation = Engine(spark, sf_dir).table("nation")
    return formats.read(spark, formats.write(nation, workspace(spark, "nation"), "csv"), "csv", nation.schema)


@register("json_source", "SELECT r_regionkey, r_name FROM region")
def json_source(spark, sf_dir):
    region = Engine(spark, sf_dir).table("region")
    return formats.read(spark, formats.write(region, workspace(spark, "region"), "json"), "json", region.schema)


@register("orc_source", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def orc_source(spark, sf_dir):
    part = Engine(spark, sf_dir).table("part").select("p_partkey", "p_brand", "p_retailprice")
    return formats.read(spark, formats.write(part, workspace(spark, "part"), "orc"), "orc")


@register("insert_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, NULL")
def insert_rows(spark, sf_dir):
    table = SnapshotTable.create(Engine(spark, sf_dir).table("region"), workspace(spark, "insert"))
    table.insert(spark.createDataFrame([(100, "ATLANTIS"), (101, None)], "r_regionkey int, r_name string"))
    return table.read()


@register("create_table_as", f"SELECT o_orderpriority, COUNT(*) AS n, {SUM.format('o_totalprice')} AS total FROM orders GROUP BY o_orderpriority")
def create_table_as(spark, sf_dir):
    out = Engine(spark, sf_dir).table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), agg.money("o_totalprice").alias("total"))
    return formats.read(spark, formats.write(out, workspace(spark, "ctas")))


@register("partition_pruned_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partition_pruned_scan(spark, sf_dir):
    orders = Engine(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus")
    path = formats.write(orders, workspace(spark, "orders"), partition_by=["o_orderstatus"])
    return formats.read(spark, path).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


# --- projection and predicates ---------------------------------------------------------------------

for op, word in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):

    def _compare(df: DataFrame, op: str = op) -> DataFrame:
        return df.where(where("l_linenumber", op, 3).expression()).select("l_orderkey", "l_linenumber")

    rows(f"filter_int_{word}", "lineitem", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber {op} 3")(_compare)

statement("filter_str_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
statement("filter_str_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
statement("filter_str_cmp", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
statement("filter_decimal_constant", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 3.5 AND l_discount >= 0.05")
statement("filter_negative_constant", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
statement("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 40)")
statement("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%zz%'")
statement("filter_is_null", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg IS NULL")
statement("filter_null_comparison", "SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg <> 'MACHINERY'")
statement("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax < l_discount")
statement("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber % 3 AS m FROM lineitem")
statement("column_and_table_alias", "SELECT c.c_name AS customer, c.c_acctbal AS balance FROM customer AS c WHERE c.c_acctbal > 0")
statement("case_expression", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")


@rows("filter_and_str_last", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def filter_and_str_last(df):
    return df.where(all_of(where("l_quantity", ">", 25), where("l_returnflag", "=", "R")).expression()).select("l_orderkey", "l_linenumber")


@rows("filter_or_not_paren", "part", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11')")
def filter_or_not_paren(df):
    tree = all_of(any_of(where("p_size", "<", 5), where("p_size", ">", 45)), negate(where("p_brand", "=", "Brand#11")))
    return df.where(tree.expression()).select("p_partkey")


@rows("filter_between", "part", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1100")
def filter_between(df):
    return df.where(where("p_retailprice", "between", (950, 1100)).expression()).select("p_partkey", "p_retailprice")


@rows("filter_contains", "part", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
def filter_contains(df):
    return df.where(where("p_name", "contains", "a").expression()).select("p_partkey")


@rows("distinct_values", "customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_values(df):
    return df.select("c_mktsegment", "c_nationkey").distinct()


# --- joins -----------------------------------------------------------------------------------------

_JOINED = "SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
for kind in ("auto", "broadcast", "merge", "hash"):

    @register(f"join_inner_{kind}", _JOINED)
    def _inner(spark, sf_dir, kind=kind):
        e = Engine(spark, sf_dir)
        out = joins.join(e.table("lineitem"), e.table("orders"), F.expr("o_orderkey = l_orderkey"), "inner", kind)
        return out.select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


for how in ("left", "right", "full"):

    @register(f"join_{how}", f"SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_nationkey < 10) c {how.upper()} JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
    def _outer(spark, sf_dir, how=how):
        e = Engine(spark, sf_dir)
        left, right = e.table("customer").where("c_nationkey < 10"), e.table("supplier").where("s_nationkey > 5")
        left, right = left.select("c_custkey", "c_nationkey", "c_acctbal"), right.select("s_suppkey", "s_nationkey", "s_acctbal")
        return joins.inequality_join(left, right, "c_nationkey", "s_nationkey", "c_acctbal", "s_acctbal", how).select("c_custkey", "s_suppkey")


statement("join_theta", "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
statement("join_nested_loop", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey > n_regionkey")
statement("join_chain", f"SELECT r_name, COUNT(*) AS n, {SUM.format('o_totalprice')} AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
statement("join_null_keys", "SELECT a.c_custkey AS a, b.n_nationkey AS b FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT n_nationkey, nullif(n_nationkey, 3) AS k FROM nation) b ON a.k = b.k")
statement("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
statement("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
statement("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")


@register("range_join", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 20")
def range_join(spark, sf_dir):
    e = Engine(spark, sf_dir)
    spans = e.table("part").selectExpr("p_partkey", "p_retailprice * 100 AS low", "p_retailprice * 100 + 20 AS high")
    return joins.range_join(e.table("orders"), spans, "o_totalprice", "low", "high", 20.0).select("o_orderkey", "p_partkey")


@register("asof_join", "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf_dir):
    events = Engine(spark, sf_dir).table("events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    others = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(others, bought, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


# --- aggregation -----------------------------------------------------------------------------------


@register("dashboard_two_key", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, {SUM.format('l_extendedprice')} AS total, {AVG.format('l_extendedprice')} AS mean, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem GROUP BY l_returnflag, l_linestatus")
def dashboard_two_key(spark, sf_dir):
    total = agg.money("l_extendedprice")
    made = [F.count("*").alias("cnt"), total.alias("total"), (total / F.count("l_extendedprice")).alias("mean"), F.min("l_quantity").alias("mn"), F.max("l_quantity").alias("mx")]
    return Engine(spark, sf_dir).table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(*made)


statement("count_star", "SELECT COUNT(*) AS n FROM lineitem")
statement("count_filtered", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 10")
statement("agg_sum", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem")
statement("agg_avg", "SELECT AVG(l_linenumber) AS a FROM lineitem")
statement("agg_min_max", "SELECT MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi, MIN(l_returnflag) AS f, MAX(l_shipdate) AS d FROM lineitem")
statement("agg_filtered", f"SELECT COUNT(*) AS n, {SUM.format('o_totalprice')} AS total, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F'")
statement("agg_empty_input", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_quantity) AS a, MIN(l_orderkey) AS lo FROM lineitem WHERE l_orderkey < 0")
statement("count_col_nulls", "SELECT COUNT(*) AS n, COUNT(seg) AS present FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t")
statement("group_by_expr", "SELECT l_linenumber % 2 AS parity, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 2")
statement("group_null_key", "SELECT seg, COUNT(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t GROUP BY seg")
statement("group_by_where", f"SELECT l_returnflag, COUNT(*) AS n, {SUM.format('l_extendedprice')} AS total FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
statement("group_by_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
statement("count_distinct", "SELECT COUNT(DISTINCT c_nationkey) AS nations, COUNT(DISTINCT c_mktsegment) AS segments FROM customer")
statement("group_by_date", "SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)")
statement("group_by_month", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2")
statement("top_groups", "SELECT l_partkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 10")
statement("rollup_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
statement("cube", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
statement("filter_clause", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS big FROM orders GROUP BY o_orderpriority")


@rows("group_by_one", "orders", "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
def group_by_one(df):
    return agg.aggregate(df, ["o_orderstatus"], [("count", "*", "n"), ("min", "o_totalprice", "lo"), ("max", "o_totalprice", "hi")])


@rows("group_by_two", "lineitem", "SELECT l_returnflag, l_linenumber, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag, l_linenumber HAVING COUNT(*) > 10")
def group_by_two(df):
    return agg.aggregate(df, ["l_returnflag", "l_linenumber"], [("count", "*", "n"), ("sum", "l_linenumber", "s"), ("count_distinct", "l_suppkey", "d")], having=F.col("n") > 10)


@rows("overflow_safe_sum", "orders", "SELECT CAST(NULL AS BIGINT) AS s, COUNT(*) AS n FROM orders")
def overflow_safe_sum(df):
    big = df.select((F.lit(9223372036854775806) - F.col("o_orderkey") * 0).alias("x"))
    return agg.aggregate(big, [], [("try_sum", "x", "s"), ("count", "*", "n")])


# --- order, limit, top-k ---------------------------------------------------------------------------

statement("limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
statement("offset_past_end", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100000000")


@rows("order_multi_desc_nulls", "orders", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50")
def order_multi_desc_nulls(df):
    df = df.select("o_orderkey", "o_totalprice", F.expr("nullif(o_orderpriority, '1-URGENT')").alias("p"))
    return top_k(df, [pg_order("p", desc=True), pg_order("o_totalprice"), pg_order("o_orderkey")], 50).select("o_orderkey", "p")


@rows("topk_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def topk_offset(df):
    return top_k(df.select("o_orderkey", "o_totalprice"), [pg_order("o_totalprice", desc=True), pg_order("o_orderkey")], 10, 5)


@rows("topk_per_group", "orders", "SELECT o_orderstatus, o_orderkey, rn FROM (SELECT o_orderstatus, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
def topk_per_group(df):
    return top_k_per_group(df, ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderstatus", "o_orderkey", "rn")


# --- writes and transactions -----------------------------------------------------------------------


@register("update_case_when", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_case_when(spark, sf_dir):
    table = SnapshotTable.create(Engine(spark, sf_dir).table("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), workspace(spark, "update"))
    table.update(F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBTOR")})
    return table.read().select("c_custkey", "c_mktsegment")


@register("delete_predicate", "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', false)")
def delete_predicate(spark, sf_dir):
    table = SnapshotTable.create(Engine(spark, sf_dir).table("customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS seg"), workspace(spark, "delete"))
    table.delete(F.col("seg") == "MACHINERY")
    return table.read().select("c_custkey")


@register("rollback_keeps_rows", "SELECT COUNT(*) AS n FROM nation")
def rollback_keeps_rows(spark, sf_dir):
    table = SnapshotTable.create(Engine(spark, sf_dir).table("nation"), workspace(spark, "rollback"))
    t = table.begin()
    t.delete()
    t.rollback()
    return table.read().agg(F.count("*").alias("n"))


# --- layouts that stand for indexes ----------------------------------------------------------------

statement("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 500")
statement("range_lookup", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200")


@register("sorted_layout_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def sorted_layout_lookup(spark, sf_dir):
    path = formats.write_sorted(Engine(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey"), workspace(spark, "sorted"), ["o_custkey"])
    return formats.read(spark, path).where("o_custkey = 7")


@register("bloom_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (17, 42)")
def bloom_lookup(spark, sf_dir):
    path = formats.write_bloom(Engine(spark, sf_dir).table("part").select("p_partkey", "p_name"), workspace(spark, "bloom"), ["p_partkey"])
    return formats.read(spark, path).where("p_partkey IN (17, 42)")


@rows("bitmap_index_build", "customer", "SELECT c_mktsegment AS value, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def bitmap_index_build(df):
    index = formats.bitmap_index(df, "c_mktsegment", "c_custkey")
    return index.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("n"))


@rows("bitmap_or_count", "orders", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')")
def bitmap_or_count(df):
    return formats.bitmap_count(formats.bitmap_index(df, "o_orderstatus", "o_orderkey"), ["F", "P"])


@rows("bitmap_and_count", "orders", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def bitmap_and_count(df):
    of = lambda column, value: formats.bitmap_index(df, column, "o_orderkey").where(F.col("value") == value)
    return formats.bitmap_and_count(of("o_orderstatus", "F"), of("o_orderpriority", "1-URGENT"))


@rows("lsm_latest_version", "events", "SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1 AND event_type <> 'error'")
def lsm_latest_version(df):
    return formats.latest_version(df, "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_id", "event_type")


statement("bloom_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)")


@register("index_advice", "SELECT * FROM (VALUES ('o_orderstatus', '=', 'partition or bitmap: few values'), ('o_totalprice', '>', 'sort: range pruning by row-group statistics')) AS t(\"column\", op, advice)")
def index_advice(spark, sf_dir):
    advice = profile.layout_advice(Engine(spark, sf_dir).table("orders"), [("o_orderstatus", "="), ("o_totalprice", ">")])
    return spark.createDataFrame(advice, "column string, op string, advice string")


@register("bucketed_join", "SELECT c_nationkey, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def bucketed_join(spark, sf_dir):
    """Both tables written in 8 buckets of the key: the join has no shuffle of them."""
    e = Engine(spark, sf_dir)
    made = []
    for table, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        name = f"basalt_{table}_{uuid.uuid4().hex}"
        made.append(formats.write_bucketed(e.table(table), name, workspace(spark, name), 8, [key]))
    customer, orders = map(spark.table, made)
    return joins.join(orders, customer, F.expr("c_custkey = o_custkey"), strategy="merge").groupBy("c_nationkey").agg(F.count("*").alias("n"))


# --- cache, profile --------------------------------------------------------------------------------


@register("cached_equals_uncached", "SELECT l_shipmode_count AS n FROM (SELECT COUNT(DISTINCT l_suppkey) AS l_shipmode_count FROM lineitem) t")
def cached_equals_uncached(spark, sf_dir):
    cache = ResultCache()
    plan = lambda: Engine(spark, sf_dir).table("lineitem").agg(F.countDistinct("l_suppkey").alias("n"))
    cache.warm([(plan(), ["lineitem"])])
    return cache.get(plan(), ["lineitem"])


@register(
    "column_profile",
    "SELECT COUNT(*) AS n, COUNT(DISTINCT v) AS n_distinct, CAST(SUM(CASE WHEN k = 1 OR v IS DISTINCT FROM p THEN 1 ELSE 0 END) AS BIGINT) AS n_runs, MIN(v - p) AS min_delta, MAX(v - p) AS max_delta FROM (SELECT l_linenumber AS v, LAG(l_linenumber) OVER w AS p, ROW_NUMBER() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) t",
)
def column_profile(spark, sf_dir):
    return profile.column_profile(Engine(spark, sf_dir).table("lineitem"), "l_linenumber", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"])


statement("column_cardinality", "SELECT COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_shipdate) AS dates FROM lineitem")


# --- planned query features, set operations, streams -----------------------------------------------


@rows("window_rank", "orders", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS d FROM orders")
def window_rank(df):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))
    return df.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))


statement("window_running_total", "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders")
statement("cte_filter", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN big ON c_custkey = o_custkey WHERE n >= 3")
statement("union_intersect_except", "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < -500")
statement("intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
statement("except_rows", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")


@rows("json_extract", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(df):
    return df.select("event_id", scalar.json_text("props", "k").cast("long").alias("k"))


@rows("array_concat_size", "embeddings", "SELECT vec_id, CAST(len(list_concat(embedding, embedding)) AS INTEGER) AS n FROM embeddings")
def array_concat_size(df):
    return df.select("vec_id", F.size(scalar.array_append_all("embedding", "embedding")).alias("n"))


@register("materialized_daily", f"SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n, {SUM.format('o_totalprice')} AS total FROM orders GROUP BY 1")
def materialized_daily(spark, sf_dir):
    daily = Engine(spark, sf_dir).table("orders").groupBy(scalar.day("o_orderdate").alias("d")).agg(F.count("*").alias("n"), agg.money("o_totalprice").alias("total"))
    return formats.read(spark, formats.write(daily, workspace(spark, "daily")))


_DAILY_EVENTS = "SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


@rows("event_windows", "events", _DAILY_EVENTS.replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def event_windows(df):
    return windows.tumbling_counts(df)


@register("event_windows_stream", _DAILY_EVENTS.replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def event_windows_stream(spark, sf_dir):
    events = Engine(spark, sf_dir).table("events")
    source = formats.write(events, workspace(spark, "stream-source"))
    return windows.run_to_table(spark, source, events.schema, workspace(spark, "stream-out"), workspace(spark, "stream-state"))
