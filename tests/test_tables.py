"""Snapshot tables, SQL statements on them, layouts and joins: what the rows alone do not show."""

import threading

import pytest
from pyspark.sql import functions as F

from basalt.engine import Engine
from basalt.operators import joins
from basalt.plans import profile
from basalt.plans.cache import ResultCache
from basalt.registry import queries
from basalt.sources import formats
from basalt.sources.layouts import Layouts
from basalt.sources.snapshots import Conflict, SnapshotTable

SF = "/root/testdata/sf0.001"


def files(table):
    return set(table.manifest(table.version())[1])


def test_inserts_add_files_and_changes_rewrite_only_hit_ones(spark, tmp_path):
    table = SnapshotTable.create(spark.range(100).selectExpr("id", "id % 7 AS k").repartitionByRange(4, "id"), f"{tmp_path}/t")
    first = files(table)
    table.insert(spark.createDataFrame([(200, 1)], "id long, k long"))
    assert first < files(table) and table.read().count() == 101
    before = files(table)
    assert table.update(F.col("id") < 3, {"k": F.lit(70)}) == 3
    assert len(before - files(table)) == 1 and table.read().where("k = 70").count() == 3
    assert table.delete(F.col("id") == 1000) == 0 and table.version() == 2  # nothing changed, nothing committed
    assert table.read(0).count() == 100 and table.vacuum() and table.read().count() == 101


def test_null_conditions_change_nothing(spark, tmp_path):
    table = SnapshotTable.create(spark.createDataFrame([(1, None), (2, 5)], "a int, b int"), f"{tmp_path}/t")
    assert table.update(F.col("b") > 1, {"b": F.lit(0)}) == 1 and table.delete(F.col("b") != 0) == 0
    assert sorted(map(tuple, table.read().collect())) == [(1, None), (2, 0)]


def test_first_committer_wins_and_inserts_go_on(spark, tmp_path):
    table = SnapshotTable.create(spark.range(10), f"{tmp_path}/t")
    a, b, c = table.begin(), table.begin(), table.begin()
    a.delete(F.col("id") == 1)
    b.delete(F.col("id") == 2)
    c.insert(spark.range(50, 52))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    c.commit()
    assert sorted(r.id for r in table.read().collect()) == [0, *range(2, 10), 50, 51]


def test_a_version_is_committed_once_by_many_writers(spark, tmp_path):
    table = SnapshotTable.create(spark.range(1), f"{tmp_path}/t")
    won = []

    def race(k):
        try:
            table._commit(1, table.manifest(0)[0], [f"data/{k}"])
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and table.manifest(1)[1] == [f"data/{won[0]}"]


def test_statements(spark, tmp_path):
    e = Engine(spark, SF, f"{tmp_path}/store")
    e.sql("CREATE TABLE t (a INT, b STRING)")
    assert e.sql("INSERT INTO t VALUES (1, 'x'), (2, 'it''s; UPDATE t SET a = 0')").first().n == 2
    assert e.sql("UPDATE t SET a = a + 10 WHERE b LIKE 'it%'").first().n == 1
    assert e.sql("DELETE FROM t WHERE a = 1").first().n == 1
    assert [tuple(r) for r in e.sql("SELECT * FROM t").collect()] == [(12, "it's; UPDATE t SET a = 0")]
    with pytest.raises(ValueError):
        e.sql("INSERT INTO t (a, z) VALUES (1, 2)")
    with pytest.raises(ValueError):
        e.sql("UPDATE nation SET n_name = 'x'")
    assert "t" in e.tables() and e.sql("DROP TABLE t").first().n == 0 and "t" not in e.tables()
    with pytest.raises(ValueError):
        e.sql("DROP TABLE t")


def test_names_in_strings_are_no_tables_and_views_stay(spark):
    e = Engine(spark, SF)
    spark.range(3).createOrReplaceTempView("nation")
    assert e.sql("SELECT 'orders' AS s FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)").count() == 5
    assert spark.table("nation").count() == 3 and "orders" not in [t.name for t in spark.catalog.listTables()]
    spark.catalog.dropTempView("nation")


def test_bucketed_joins_shuffle_nothing_of_the_tables(spark):
    plan = queries()["bucketed_join"](spark, SF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "c_custkey" not in "".join(line for line in text.split("\n") if "Exchange hashpartitioning" in line)


def test_layouts_are_chosen_by_what_they_hold(spark, tmp_path):
    nation, known = spark.read.parquet(f"{SF}/nation.parquet"), Layouts(spark)
    known.create("b", "nation", nation, ["n_regionkey"], include=["n_name"])
    assert known.choose("nation", "n_regionkey", "between", ["n_name"]).name == "b" and known.choose("nation", "n_regionkey", "=", ["n_comment"]) is None
    known.drop("b")
    assert known.choose("nation", "n_regionkey", "=", ["n_name"]) is None


def test_other_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    where = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "t", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    formats.write(df.coalesce(1), "", "jdbc", **where)
    assert sorted(map(tuple, formats.read(spark, "", "jdbc", **where).collect())) == [(1, "a"), (2, None)]
    path = formats.write(df.select("s").where("s is not null"), f"{tmp_path}/text", "text")
    assert [r.value for r in formats.read(spark, path, "text").collect()] == ["a"]


def test_bitmaps_as_rows_and_blooms_without_errors_of_one_kind(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 32768, 32769, 70000)] + [("b", 5)], "v string, r long")
    assert {tuple(r) for r in formats.bitmap_rows(formats.bitmap_index(df, "v", "r")).collect()} == {("a", 1), ("a", 2), ("a", 32768), ("a", 32769), ("a", 70000), ("b", 5)}
    some, others = spark.range(0, 2000).toDF("x"), spark.range(10_000, 14_000).toDF("x")
    index = formats.bloom_index(some, "x", 1 << 15, 4)
    assert formats.bloom_contains(index, some, "x", 1 << 15, 4).count() == 2000
    rate = formats.bloom_false_positives(index, 1 << 15, 4).first().fpr
    assert abs(formats.bloom_contains(index, others, "x", 1 << 15, 4).count() / 4000 - rate) < 0.01


def test_interval_join_and_statistics_on_odd_rows(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, None, 3), (4, 9, 30)], "a int, lo int, hi int")
    b = spark.createDataFrame([(1, 10, 12), (2, 0, 1), (3, 9, 10)], "b int, lo2 int, hi2 int")
    got = {(r.a, r.b) for r in joins.interval_join(a, b, "lo", "hi", "lo2", "hi2", 4.0).collect()}
    assert got == {(1, 2), (1, 3), (4, 1), (4, 3)}
    k = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert tuple(joins.join_statistics(k, k.toDF("j"), "k", "j").first()) == (3, 3, 5, 2)


def test_promotion_and_profiles(spark):
    cache = ResultCache(promote_after=2)
    plan = lambda: spark.range(5).selectExpr("sum(id) AS s")
    cache.get(plan())
    assert cache.stats()["entries"] == 0 and cache.get(plan()).first().s == 10 and cache.stats()["entries"] == 1
    cache.clear()
    assert profile.codec_advice("int", 100, 90, False, 90) == "bitpack" and profile.codec_advice("int", 100, 3, False, 10) == "rle"
    with pytest.raises(ValueError):
        profile.column_profile(spark.range(3), "id", ["id"], [])
    one = spark.createDataFrame([(5,), (5,), (None,)], "v int")
    assert [tuple(r) for r in profile.histogram(one, "v", 4).collect()] == [(0, 2, 5, 5)]


ODD_LEFT = [(1, 1, 5.0), (2, 1, 5.0), (3, 1, None), (4, None, 9.0), (5, 2, 1.0), (6, 3, 7.0), (7, 1, float("nan")), (8, 1, 0.0), (9, 1, 5.0), (9, 1, 5.0), (10, 5, 4.0)]
ODD_RIGHT = [(1, 1, 4.0), (2, 1, 5.0), (3, 1, None), (4, None, 1.0), (5, 2, 1.0), (6, 4, 0.0), (7, 1, float("nan")), (8, 1, -0.0), (8, 1, -0.0), (9, 5, 4.5), (10, 5, 3.5)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("part_rows", [1, 2, 100])
def test_joins_in_parts_are_the_plain_joins(spark, how, part_rows):
    left, right = spark.createDataFrame(ODD_LEFT, "a int, k int, v double"), spark.createDataFrame(ODD_RIGHT, "b int, j int, w double")
    plain = sorted(map(str, joins.join(left, right, F.expr("k = j AND v > w"), how).collect()))
    assert sorted(map(str, joins.inequality_join(left, right, "k", "j", "v", "w", how, part_rows).collect())) == plain
    none = joins.inequality_join(left.where("false"), right, "k", "j", "v", "w", how, part_rows)
    assert none.count() == (len(ODD_RIGHT) if how in ("right", "full") else 0)


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_no_task_joins_all_rows_of_one_key(spark, tmp_path, how):
    spark.range(6000).selectExpr("id AS c_custkey", "7 AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5000).selectExpr("id AS s_suppkey", "7 AS s_nationkey", "CAST(id AS DOUBLE) AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    tasks = queries()[f"join_{how}"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    met = sum(min(c, 5000) for c in range(6000))
    assert sum(r["count"] for r in tasks) == met + (how != "right")
    assert max(r["count"] for r in tasks) < 0.8 * met


def test_blooms_grow_with_their_rows(spark, tmp_path):
    spark.range(150_000).selectExpr("id AS p_partkey", "IF(id < 140000, 5, 15) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert tuple(queries()["bloom_algebra"](spark, str(tmp_path)).first()) == (140_000, 10_000, True)
    assert queries()["bloom_contains"](spark, str(tmp_path)).first().kept == 10_000
    assert formats.bloom_bits(0) == formats.bloom_bits(1000) == 1 << 20 and formats.bloom_bits(10**7) > 10**8


def test_encodings_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "FILE_ROWS", 1000, raising=False)
    monkeypatch.setattr("basalt.catalog_more.workspace", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, queries()["encodings_read_back"](spark, SF).collect()))
    assert got == [("flag", True, False), ("id", False, True)]
    files = spark.read.parquet(f"{tmp_path}/encodings").groupBy(F.input_file_name()).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(files) > 3 and sum(f.n for f in files) == lines and max(f.n for f in files) < lines / 2
    assert all(a.high < b.low for a, b in zip(files, files[1:], strict=False))
