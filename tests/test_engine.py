"""Golden literals, NULLs, empty inputs and plans of the engine's own operators."""

import pytest
from pyspark.sql import functions as F

from basalt.engine import Engine
from basalt.operators import aggregates as agg
from basalt.operators import joins
from basalt.operators.ordering import pg_order, top_k
from basalt.operators.predicates import all_of, any_of, negate, where
from basalt.plans import profile
from basalt.plans.cache import ResultCache
from basalt.sources import formats
from basalt.sources.snapshots import Conflict, SnapshotTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def users(spark):
    status, dept = ("active", "inactive", "pending", "terminated"), ("Engineering", "Sales", "Marketing", "HR", "Finance")
    rows = [(i, f"User{i}", 20 + i % 50, status[i % 4], 30000 + i % 100 * 1000, dept[i % 5]) for i in range(1, 10_001)]
    return spark.createDataFrame(rows, "id long, name string, age long, status string, salary long, department string").cache()


def test_read_shapes(users):
    assert users.where(where("id", "=", 5000).expression()).count() == 1
    assert users.where(where("status", "=", "active").expression()).count() == 2500
    assert users.where(where("department", "=", "Engineering").expression()).count() == 2000
    assert users.where(where("age", "between", (30, 40)).expression()).count() == 2200
    assert users.groupBy("department").count().count() == 5
    both = all_of(where("age", ">", 25), where("status", "=", "active"))
    assert users.where(both.expression()).count() == sum(20 + i % 50 > 25 and i % 4 == 0 for i in range(1, 10_001))
    assert users.where(negate(any_of(where("age", "<", 60), where("age", ">", 65))).expression()).count() == 1200


def test_golden_aggregates(spark):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), ("B", 40), ("C", 50)], "g string, v long")
    total = agg.aggregate(df, [], [("count", "*", "n"), ("sum", "v", "s"), ("avg", "v", "a"), ("min", "v", "lo"), ("max", "v", "hi")]).first()
    assert tuple(total) == (5, 150, 30.0, 10, 50)
    assert sorted(map(tuple, agg.aggregate(df, ["g"], [("count", "*", "n"), ("sum", "v", "s")]).collect())) == [("A", 2, 30), ("B", 2, 70), ("C", 1, 50)]
    assert tuple(agg.aggregate(df, [], [("count", "*", "n"), ("sum", "v", "s")], where=F.lit(False)).first()) == (0, None)


def test_order_and_limits(spark):
    df = spark.createDataFrame([(50,), (10,), (None,), (30,), (20,), (40,)], "v long")
    assert [r.v for r in df.orderBy(pg_order("v")).collect()] == [10, 20, 30, 40, 50, None]
    assert [r.v for r in df.orderBy(pg_order("v", desc=True)).collect()] == [None, 50, 40, 30, 20, 10]
    assert [r.v for r in top_k(df, [pg_order("v")], 3, 1).collect()] == [20, 30, 40]
    assert top_k(df, [pg_order("v")], 3, 100).count() == 0


@pytest.mark.parametrize("kind", list(joins.STRATEGIES))
def test_every_strategy_joins_alike(spark, kind):
    left = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 2)], "a long, k long")
    right = spark.createDataFrame([(10, 1), (11, 1), (12, None), (13, 3)], "b long, j long")
    out = joins.join(left, right, F.expr("k = j"), "inner", kind)
    assert sorted((r.a, r.b) for r in out.collect()) == [(1, 10), (1, 11), (2, 10), (2, 11)]


def test_join_demo(spark):
    users = spark.createDataFrame([(i, 1 + i % 3) for i in range(8)], "id long, dept long")
    depts = spark.createDataFrame([(1, "E"), (2, "S"), (3, "M"), (4, "HR")], "d long, name string")
    on = F.expr("dept = d")
    assert [joins.join(users, depts, on, how).count() for how in ("inner", "left", "right", "full")] == [8, 8, 9, 9]


def test_broadcast_only_within_a_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", 0)
    a, b = spark.range(10).toDF("a"), spark.range(10).toDF("b")
    plan = joins.join(a, b, F.expr("a = b"), strategy="broadcast")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


def test_asof_and_range_join_edges(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("x", 5, 1.0), ("x", 2, 2.0), ("z", 1, 3.0)], "k string, t long, v double")
    got = {(r.k, r.t): r.found for r in joins.asof_join(left, right, "k", "t", "v", "found").collect()}
    assert got == {("x", 5): 1.0, ("x", 1): None, ("y", 9): None, (None, 3): None}
    spans = spark.createDataFrame([(1, 0.0, 25.0), (2, 20.0, 21.0)], "s long, lo double, hi double")
    points = spark.createDataFrame([(0.0,), (20.5,), (25.0,), (None,)], "p double")
    assert sorted((r.p, r.s) for r in joins.range_join(points, spans, "p", "lo", "hi", 10.0).collect()) == [(0.0, 1), (20.5, 1), (20.5, 2)]


def test_parameters_are_values(spark):
    e = Engine(spark, SF)
    assert e.sql("SELECT :a AS a", {"a": "'; DROP TABLE x; --"}).first().a == "'; DROP TABLE x; --"
    assert tuple(e.sql("SELECT ?, ?", [1, "$10"]).first()) == (1, "$10")
    e.register("tiny", spark.range(3))
    assert "tiny" in e.tables()
    e.drop("tiny")
    assert "tiny" not in e.tables()


def test_plans(spark):
    e = Engine(spark, SF)
    plan = lambda df: df._jdf.queryExecution().toString()
    scan = plan(e.sql("SELECT o_orderkey FROM orders WHERE o_orderkey = 500"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,500)]" in scan and "ReadSchema: struct<o_orderkey:bigint>" in scan
    assert "TakeOrderedAndProject" in plan(top_k(e.table("orders"), [pg_order("o_orderkey")], 5))
    assert "partial_count" in plan(e.sql("SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY 1"))


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 35)], "id long, name string, age long")
    t = SnapshotTable.create(df, f"file://{tmp_path}/t")
    old = t.version()
    assert t.update(F.col("name") == "Bob", {"age": F.lit(31)}) == 1
    assert t.delete(F.col("name") == "Charlie") == 1
    assert sorted(map(tuple, t.read().collect())) == [(1, "Alice", 25), (2, "Bob", 31)]
    assert t.read(old).count() == 3
    a, b = t.begin(), t.begin()
    a.insert(spark.createDataFrame([(100, "Test User", 1)], df.schema))
    b.delete()
    assert a.read().count() == 3 and b.read().count() == 0 and t.read().count() == 2
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert t.read().where("id = 100").first().name == "Test User"
    assert t.vacuum() and t.read().count() == 3
    with pytest.raises(ZeroDivisionError), t.begin() as c:
        c.delete()
        1 / 0  # noqa: B018
    assert t.read().count() == 3


def test_cache(spark):
    now = [0.0]
    cache = ResultCache(ttl=10, most=2, clock=lambda: now[0])
    plan = lambda n: spark.range(n).where("id > 1")
    cache.get(plan(5), ["a"])
    assert cache.get(plan(5), ["a"]).count() == 3 and cache.hits == 1
    cache.get(plan(6), ["b"])
    cache.get(plan(7), ["b"])
    assert cache.stats()["evictions"] == 1 and len(cache.entries) == 2
    assert cache.invalidate("b") == 2
    cache.get(plan(5), ["a"])
    now[0] = 11
    assert cache.sweep() == 1 and cache.warm([(plan(8), [])]) == 1
    cache.clear()
    assert not cache.entries


def test_profile_and_advice(spark):
    df = spark.createDataFrame([(i, 1000 + 5 * i) for i in range(100)], "i long, v long")
    r = profile.column_profile(df.withColumn("g", F.lit(1)), "v", ["i"], ["g"]).first()
    assert tuple(r) == (100, 100, 100, 5, 5)
    assert profile.codec_advice("bigint", 100, 100, True) == "delta"
    assert profile.codec_advice("string", 200, 5, False) == "dictionary"
    assert [a[2].split(":")[0] for a in profile.layout_advice(df, [("v", "<"), ("v", "=")])] == ["sort", "partition or bitmap"]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "k long, s string")
    for kind in formats.FORMATS:
        path = formats.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(str, formats.read(spark, path, kind, df.schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        formats.read(spark, path, "csv")
    assert formats.compact(spark, f"{tmp_path}/parquet", f"{tmp_path}/compact") == 1
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 2


def test_overflow_is_an_error_or_null(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,)], "v long")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.agg(F.sum("v")).collect()
    assert agg.aggregate(df, [], [("try_sum", "v", "s")]).first().s is None
