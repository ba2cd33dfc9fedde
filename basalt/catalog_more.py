"""Further queries over the test tables: statements that write, transactions, layouts, set operations, windows, statistics, streams, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog_queries import rows, statement
from .engine import Engine
from .functions import udf
from .operators import aggregates as agg
from .operators import joins
from .plans import profile
from .plans.cache import ResultCache
from .plans.views import MaterializedView
from .registry import register
from .sources import formats
from .sources.layouts import Layouts
from .sources.snapshots import SnapshotTable
from .sources.workspace import workspace
from .streaming import windows

# --- statements that write -------------------------------------------------------------------------


def script(name: str, oracle: str, *statements: str):
    """Register statements run one after another on a new store; the last one's rows are the result."""

    @register(name, oracle)
    def run(spark, sf_dir):
        engine = Engine(spark, sf_dir)
        for text in statements[:-1]:
            engine.sql(text)
        return engine.sql(statements[-1])


script("sql_insert", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, NULL",
       "CREATE TABLE places (id INT, name STRING)", "INSERT INTO places SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", "INSERT INTO places VALUES (100, 'ATLANTIS')", "INSERT INTO places (id) VALUES (101)", "SELECT * FROM places")
script("sql_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment FROM customer",
       "CREATE TABLE clients AS SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", "UPDATE clients SET c_mktsegment = 'DEBTOR', c_acctbal = c_acctbal * 2 WHERE c_acctbal < 0", "SELECT * FROM clients")
script("sql_update_count", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal < 0",
       "CREATE TABLE clients AS SELECT c_custkey, c_acctbal FROM customer", "UPDATE clients SET c_acctbal = 0 WHERE c_acctbal < 0")
script("sql_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)",
       "CREATE TABLE sales AS SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "DELETE FROM sales WHERE o_orderstatus = 'F' AND o_totalprice > 1000", "SELECT o_orderkey FROM sales")
script("sql_delete_all", "SELECT r_regionkey FROM region WHERE false", "CREATE TABLE areas AS SELECT r_regionkey FROM region", "DELETE FROM areas", "SELECT r_regionkey FROM areas")
script("create_drop", "SELECT 'kept' AS table_name",
       "CREATE TABLE kept (a INT)", "CREATE TABLE gone (a INT, b DOUBLE)", "DROP TABLE gone", "DROP TABLE IF EXISTS never", "CREATE TABLE IF NOT EXISTS kept (z INT)", "SELECT 'kept' AS table_name WHERE (SELECT COUNT(*) FROM kept) = 0")
script("transaction_commit", "SELECT r_regionkey + 10 AS k FROM region WHERE r_regionkey <> 2",
       "CREATE TABLE areas AS SELECT r_regionkey AS k FROM region", "BEGIN", "DELETE FROM areas WHERE k = 2", "UPDATE areas SET k = k + 10", "COMMIT", "SELECT k FROM areas")
script("transaction_rollback", "SELECT r_regionkey AS k FROM region", "CREATE TABLE areas AS SELECT r_regionkey AS k FROM region", "BEGIN TRANSACTION", "DELETE FROM areas", "ROLLBACK", "SELECT k FROM areas")
script("savepoint_rollback", "SELECT r_regionkey AS k FROM region WHERE r_regionkey > 0",
       "CREATE TABLE areas AS SELECT r_regionkey AS k FROM region", "BEGIN", "DELETE FROM areas WHERE k = 0", "SAVEPOINT s", "DELETE FROM areas", "ROLLBACK TO SAVEPOINT s", "COMMIT", "SELECT k FROM areas")


@register("show_tables", "SELECT * FROM (VALUES ('made'), ('nation'), ('region')) AS t(table_name)")
def show_tables(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.sql("CREATE TABLE made (a INT)")
    return engine.sql("SHOW TABLES").where("table_name IN ('made', 'nation', 'region', 'never')")


@register("information_columns", "SELECT * FROM (VALUES ('made', 'a', 1, 'int'), ('made', 'b', 2, 'string')) AS t(table_name, column_name, ordinal_position, data_type)")
def information_columns(spark, sf_dir):
    engine = Engine(spark)
    engine.sql("CREATE TABLE made (a INT, b STRING)")
    return engine.columns().drop("is_nullable")


@register("snapshot_versions", "SELECT 0 AS version, COUNT(*) AS n FROM nation UNION ALL SELECT 1, COUNT(*) + 5 FROM nation UNION ALL SELECT 2, 5 FROM region WHERE r_regionkey = 0")
def snapshot_versions(spark, sf_dir):
    nation = Engine(spark, sf_dir).table("nation")
    table = SnapshotTable.create(nation, workspace(spark, "versions"))
    table.insert(nation.where("n_nationkey < 5").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    table.delete(F.col("n_nationkey") < 100)
    out = None
    for v in table.versions():
        part = table.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register("materialized_refresh", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def materialized_refresh(spark, sf_dir):
    """A view made of half the orders; the groups that changed are refreshed one after another."""
    orders = Engine(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus")
    source = SnapshotTable.create(orders.where("o_orderkey % 2 = 0"), workspace(spark, "view-source"))
    view = MaterializedView(spark, workspace(spark, "view"), lambda: source.read().groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    source.insert(orders.where("o_orderkey % 2 <> 0"))
    view.refresh(F.col("o_orderstatus") == "F")
    view.refresh(F.col("o_orderstatus") != "F")
    return view.read()


@register("text_source", "SELECT n_name AS value FROM nation")
def text_source(spark, sf_dir):
    return formats.read(spark, formats.write(Engine(spark, sf_dir).table("nation").select("n_name"), workspace(spark, "text"), "text"), "text")


@register("codecs_read_back", "SELECT codec, n, total FROM (VALUES ('gzip'), ('lz4_raw'), ('snappy'), ('uncompressed'), ('zstd')) AS t(codec), (SELECT COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS total FROM lineitem)")
def codecs_read_back(spark, sf_dir):
    """Each codec's files, by the codec their footers name, hold the same rows."""
    lines = Engine(spark, sf_dir).table("lineitem").select("l_orderkey", "l_returnflag")
    out = None
    for codec in ("gzip", "lz4_raw", "snappy", "uncompressed", "zstd"):
        path = formats.write(lines, workspace(spark, codec), compression=codec)
        told = formats.column_chunks(spark, path).select("codec").distinct()
        part = formats.read(spark, path).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total")).join(F.broadcast(told), how="cross").select("codec", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@register("encodings_read_back", "SELECT * FROM (VALUES ('flag', true, false), ('id', false, true)) AS t(\"column\", dictionary, delta)")
def encodings_read_back(spark, sf_dir):
    """Dictionary pages for few values, delta packing for a sequence without a dictionary; the sequence is cut into files of FILE_ROWS."""
    data = Engine(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#id": "false", "parquet.enable.dictionary#flag": "true"}
    files = max(1, -(-data.count() // formats.FILE_ROWS))
    chunks = formats.column_chunks(spark, formats.write_sorted(data, workspace(spark, "encodings"), ["id"], files, **options))
    has = lambda text: F.max(F.exists("encodings", lambda e: e.contains(text)))
    return chunks.groupBy("column").agg(has("DICTIONARY").alias("dictionary"), has("DELTA_BINARY").alias("delta"))


# --- layouts ---------------------------------------------------------------------------------------


@rows("bitmap_xor_count", "orders", "SELECT COUNT(*) AS n FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority = '1-URGENT')")
def bitmap_xor_count(df):
    of = lambda column, value: formats.bitmap_index(df, column, "o_orderkey").where(F.col("value") == value)
    return formats.bitmap_xor_count(of("o_orderstatus", "F"), of("o_orderpriority", "1-URGENT"))


@rows("bitmap_range_count", "part", "SELECT COUNT(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20")
def bitmap_range_count(df):
    index = formats.bitmap_index(df, "p_size", "p_partkey").where(F.col("value").between(10, 20))
    return index.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n"))


@rows("bitmap_to_rows", "customer", "SELECT c_mktsegment AS value, c_custkey AS \"row\" FROM customer")
def bitmap_to_rows(df):
    return formats.bitmap_rows(formats.bitmap_index(df, "c_mktsegment", "c_custkey"))


@rows("bloom_contains", "part", "SELECT COUNT(*) AS kept FROM part WHERE p_size = 15")
def bloom_contains(df):
    """No member is missing from the filter's answer."""
    some, bits = df.where("p_size = 15"), formats.bloom_bits(df.count())
    found = formats.bloom_contains(formats.bloom_index(some, "p_partkey", bits), df, "p_partkey", bits)
    return found.join(some.select("p_partkey"), "p_partkey", "left_semi").agg(F.count("*").alias("kept"))


@rows("bloom_algebra", "part", "SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM part WHERE p_size > 10 AND p_size < 20) AS both, true AS few_errors FROM part WHERE p_size <= 10 OR p_size >= 20")
def bloom_algebra(df):
    """Members of a union, and of an intersection; the expected share of errors is under a hundredth."""
    bits = formats.bloom_bits(df.count())
    of = lambda where: formats.bloom_index(df.where(where), "p_partkey", bits)
    union = formats.bloom_contains(formats.bloom_union(of("p_size <= 10"), of("p_size >= 20")), df.where("p_size <= 10 OR p_size >= 20"), "p_partkey", bits)
    both = formats.bloom_contains(formats.bloom_intersect(of("p_size > 10"), of("p_size < 20")), df.where("p_size > 10 AND p_size < 20"), "p_partkey", bits)
    rate = formats.bloom_false_positives(of("p_size <= 10"), bits).select((F.col("fpr") < 0.01).alias("few_errors"))
    return union.agg(F.count("*").alias("n")).join(both.agg(F.count("*").alias("both")), how="cross").join(rate, how="cross")


@register("inverted_index_search", "SELECT p_partkey AS \"row\" FROM part WHERE list_has_all(regexp_extract_all(lower(p_name), '[a-z0-9]+'), regexp_extract_all(lower((SELECT p_name FROM part WHERE p_partkey = 1)), '[a-z0-9]+'))")
def inverted_index_search(spark, sf_dir):
    part = Engine(spark, sf_dir).table("part")
    terms = part.where("p_partkey = 1").select(F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda w: w != "")).first()[0]
    return formats.search_all(formats.inverted_index(part, "p_partkey", "p_name"), terms)


@register("covering_index", "SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def covering_index(spark, sf_dir):
    """The index holds all that is asked for, so the table is not read."""
    engine = Engine(spark, sf_dir)
    engine.sql("CREATE INDEX by_customer ON orders USING btree (o_custkey) INCLUDE (o_totalprice)")
    return engine.layouts.lookup("orders", engine.table("orders"), "o_custkey", "between", (10, 40), ["o_custkey", "o_totalprice"])


@register("index_dispatch", "SELECT * FROM (VALUES ('=', 'h'), ('in', 'h'), ('<', 'b'), ('none', 'scan')) AS t(op, used)")
def index_dispatch(spark, sf_dir):
    """Equality goes to the hash layout, ranges to the sorted one, a column without any to a scan."""
    orders, known = Engine(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), Layouts(spark)
    known.create("h", "orders", orders, ["o_custkey"], "hash")
    known.create("b", "orders", orders, ["o_custkey"], "btree")
    asked = [("=", "o_custkey", "="), ("in", "o_custkey", "in"), ("<", "o_custkey", "<"), ("none", "o_totalprice", "=")]
    chosen = [(label, known.choose("orders", column, op, ["o_orderkey"])) for label, column, op in asked]
    return spark.createDataFrame([(label, x.name if x else "scan") for label, x in chosen], "op string, used string")


@register("index_statistics", "SELECT 'b' AS name, 'nation' AS table_name, 'btree' AS kind, 'n_regionkey' AS columns, COUNT(*) AS \"rows\", CAST(1 AS BIGINT) AS uses FROM nation")
def index_statistics(spark, sf_dir):
    nation, known = Engine(spark, sf_dir).table("nation"), Layouts(spark)
    known.create("b", "nation", nation, ["n_regionkey"])
    known.lookup("nation", nation, "n_regionkey", ">=", 2, ["n_name"])
    return known.statistics()


@register("cache_promotion", "SELECT * FROM (VALUES (1, 0), (2, 0), (3, 1), (4, 1)) AS t(access, kept)")
def cache_promotion(spark, sf_dir):
    cache, out = ResultCache(promote_after=3), []
    for k in range(1, 5):
        cache.get(Engine(spark, sf_dir).table("nation").groupBy("n_regionkey").count(), ["nation"])
        out.append((k, cache.stats()["entries"]))
    cache.clear()
    return spark.createDataFrame(out, "access int, kept int")


# --- joins -----------------------------------------------------------------------------------------


@register("interval_join", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size < b.p_size + 3 AND b.p_size < a.p_size + 2 WHERE a.p_partkey < 40 AND b.p_partkey < 60")
def interval_join(spark, sf_dir):
    part = Engine(spark, sf_dir).table("part")
    left = part.where("p_partkey < 40").selectExpr("p_partkey AS a", "p_size AS lo", "p_size + 2 AS hi")
    right = part.where("p_partkey < 60").selectExpr("p_partkey AS b", "p_size AS lo2", "p_size + 3 AS hi2")
    return joins.interval_join(left, right, "lo", "hi", "lo2", "hi2", 5.0).select("a", "b")


statement("lateral_join", "SELECT n_name, t.k, t.v FROM nation, LATERAL (SELECT n_regionkey + 1 AS k, n_nationkey * 2 AS v) t")
statement("lateral_top", "SELECT r_name, t.n_name FROM region JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t ON true")


@register("join_statistics", "SELECT (SELECT COUNT(*) FROM customer) AS left_rows, (SELECT COUNT(*) FROM orders) AS right_rows, COUNT(*) AS matched_rows, COUNT(DISTINCT c_custkey) AS matched_keys FROM customer JOIN orders ON c_custkey = o_custkey")
def join_statistics(spark, sf_dir):
    e = Engine(spark, sf_dir)
    return joins.join_statistics(e.table("customer"), e.table("orders"), "c_custkey", "o_custkey")


# --- sets, windows, aggregates ---------------------------------------------------------------------

statement("union_all_rows", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
statement("intersect_all_rows", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
statement("except_all_rows", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

_ORDERED = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
statement("window_lag_lead", f"SELECT o_orderkey, LAG(o_totalprice) {_ORDERED} AS before, LEAD(o_totalprice, 2, 0.0) {_ORDERED} AS after2 FROM orders")
statement("window_first_last", f"SELECT o_orderkey, FIRST_VALUE(o_orderkey) {_ORDERED} AS f, LAST_VALUE(o_orderkey) {_ORDERED} AS l, NTH_VALUE(o_orderkey, 2) {_ORDERED} AS second FROM orders")
statement("window_ntile", f"SELECT o_orderkey, CAST(NTILE(4) {_ORDERED} AS BIGINT) AS tile, CAST(ROW_NUMBER() {_ORDERED} AS BIGINT) AS rn FROM orders")
statement("window_distribution", "SELECT p_partkey, PERCENT_RANK() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS pr, CUME_DIST() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS cd FROM part")
statement("window_range_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, MIN(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS least FROM part")
statement("window_rows_frame", "SELECT l_orderkey, l_linenumber, MAX(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) t")

statement("grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
statement("group_statistics", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_discount), 6) AS c FROM lineitem GROUP BY l_returnflag")
statement("percentiles", "SELECT o_orderstatus, MEDIAN(o_totalprice) AS med, PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90, PERCENTILE_DISC(0.25) WITHIN GROUP (ORDER BY o_orderkey) AS d25 FROM orders GROUP BY o_orderstatus",
          "SELECT o_orderstatus, MEDIAN(o_totalprice) AS med, QUANTILE_CONT(o_totalprice, 0.9) AS p90, CAST(QUANTILE_DISC(o_orderkey, 0.25) AS DOUBLE) AS d25 FROM orders GROUP BY o_orderstatus")
statement("collected_list", "SELECT n_regionkey, ARRAY_JOIN(ARRAY_SORT(COLLECT_LIST(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("boolean_aggregates", "SELECT o_orderstatus, BOOL_AND(o_totalprice > 1000) AS every_one, BOOL_OR(o_totalprice > 300000) AS some_one FROM orders GROUP BY o_orderstatus")
statement("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
statement("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t")
statement("string_functions", "SELECT c_custkey, UPPER(c_name) AS u, CAST(LENGTH(c_name) AS BIGINT) AS n, SUBSTRING(c_name, 1, 4) AS s, CONCAT(c_mktsegment, '-', c_nationkey) AS c, REPLACE(c_name, '0', 'o') AS r, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '?') AS z FROM customer")
statement("date_functions", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS m, CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS later FROM orders",
          "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS later FROM orders")
statement("pivot_rows", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (COUNT(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o))",
          "SELECT o_orderpriority, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY o_orderpriority")


@rows("column_histogram", "part", "SELECT CAST(LEAST(FLOOR((p_size - lo) / (hi - lo) * 8), 7) AS BIGINT) AS bin, COUNT(*) AS n, MIN(p_size) AS low, MAX(p_size) AS high FROM part, (SELECT CAST(MIN(p_size) AS DOUBLE) AS lo, CAST(MAX(p_size) AS DOUBLE) AS hi FROM part) GROUP BY 1")
def column_histogram(df):
    return profile.histogram(df, "p_size", 8)


@rows("described_statistics", "lineitem", "SELECT ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, MEDIAN(l_quantity) AS med FROM lineitem")
def described_statistics(df):
    return agg.aggregate(df, [], [("stddev", "l_quantity", "sd"), ("median", "l_quantity", "med")]).select(F.round("sd", 6).alias("sd"), "med")


@register("codec_choice", "SELECT * FROM (VALUES ('l_orderkey', 'rle'), ('l_linenumber', 'bitpack')) AS t(\"column\", codec)")
def codec_choice(spark, sf_dir):
    """The advice from a profile: runs of equal order numbers, packed bits for line numbers that change with each row."""
    lines, out = Engine(spark, sf_dir).table("lineitem"), []
    for column in ("l_orderkey", "l_linenumber"):
        p = profile.column_profile(lines, column, ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"]).first()
        out.append((column, profile.codec_advice("int", p.n, p.n_distinct, p.min_delta == p.max_delta and p.min_delta != 0, p.n_runs)))
    return spark.createDataFrame(out, "column string, codec string")


# --- streams, user functions -----------------------------------------------------------------------

_SLIDE = "SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) t GROUP BY 1, 2"


@rows("sliding_windows", "events", _SLIDE)
def sliding_windows(df):
    return windows.sliding_counts(df, "12 hours", "6 hours")


@rows("session_windows", "events", "SELECT user_id, CAST(MIN(ts) AS TIMESTAMP) AS session_start, CAST(MAX(ts) AS TIMESTAMP) AS last_event, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s")
def session_windows(df):
    return windows.sessions(df, "6 hours")


_FOLLOWED = "SELECT a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'click' AND b.event_type = 'purchase'"


@register("stream_stream_join", _FOLLOWED)
def stream_stream_join(spark, sf_dir):
    events = Engine(spark, sf_dir).table("events")
    source = formats.write(events, workspace(spark, "events"))
    stream = lambda kind: spark.readStream.schema(events.schema).parquet(source).where(F.col("event_type") == kind)
    return windows.run_once(windows.followed_within(stream("click"), stream("purchase"), "user_id", "ts", "1 DAY", "2 days"), workspace(spark, "joined"), workspace(spark, "joined-state"))


@register("udf_scalar", "SELECT c_custkey, c_acctbal * 2 + 1 AS v FROM customer")
def udf_scalar(spark, sf_dir):
    udf.register_scalar(spark, "basalt_twice", lambda v: v * 2 + 1, "double")
    return Engine(spark, sf_dir).sql("SELECT c_custkey, basalt_twice(c_acctbal) AS v FROM customer")


@register("udf_aggregate", "SELECT o_orderstatus, MAX(o_totalprice) - MIN(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def udf_aggregate(spark, sf_dir):
    udf.register_aggregate(spark, "basalt_spread", lambda v: float(v.max() - v.min()), "double")
    return Engine(spark, sf_dir).sql("SELECT o_orderstatus, basalt_spread(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")


class _Letters:
    def eval(self, text: str):
        for i, c in enumerate(text or ""):
            yield i, c


@register("udf_table", "SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS i, substring(n_name, i, 1) AS c FROM (SELECT n_nationkey, n_name, CAST(unnest(range(1, length(n_name) + 1)) AS INTEGER) AS i FROM nation) t")
def udf_table(spark, sf_dir):
    udf.register_table(spark, "basalt_letters", _Letters, "i int, c string")
    return Engine(spark, sf_dir).sql("SELECT n_nationkey, t.i, t.c FROM nation, LATERAL basalt_letters(n_name) t")


@rows("grouped_map", "orders", "SELECT o_orderpriority, o_orderkey, o_totalprice - AVG(o_totalprice) OVER (PARTITION BY o_orderpriority) > 0 AS above FROM orders WHERE o_orderkey < 2000")
def grouped_map(df):
    def mark(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(above=group["o_totalprice"] > group["o_totalprice"].mean())[["o_orderpriority", "o_orderkey", "above"]]

    return df.where("o_orderkey < 2000").select("o_orderpriority", "o_orderkey", "o_totalprice").groupBy("o_orderpriority").applyInPandas(mark, "o_orderpriority string, o_orderkey long, above boolean")


@rows("pg_ordered_positions", "orders", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY p DESC NULLS FIRST, o_orderkey) AS position FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) t ORDER BY position LIMIT 40")
def pg_ordered_positions(df):
    """The order itself as a column, of the first rows only: these are sorted in one task, the table is not."""
    from .operators.ordering import pg_order, top_k

    order = [pg_order("p", desc=True), pg_order("o_orderkey")]
    first = top_k(df.select("o_orderkey", F.expr("nullif(o_orderpriority, '1-URGENT')").alias("p")), order, 40)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))
