"""The input and result vectors of FIXTURES.md, part A, which results must equal; -1 ids are null. Own cases are in test_sweep, test_blocks and test_batch."""

import pytest
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path, Relation, RelationType, Table
from chronofeat.operators import target_encoding as te
from chronofeat.operators import temporal
from chronofeat.plans.paths import hops, run

MANY, ONE = RelationType.ONE_TO_MANY, RelationType.MANY_TO_ONE


def frame(spark, schema, *columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns))], "row int, " + schema)


def column(df, name="f"):
    return [None if r[name] is None else float(r[name]) for r in df.orderBy("row").collect()]


def close(got, want):
    assert [None if x is None else pytest.approx(x) for x in want] == got


X10 = [float(i) for i in range(10)]
DST = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]


def test_lookup(spark):
    src = frame(spark, "id int", [None, 0, 1, 2])
    dst = frame(spark, "id int, x double", [0, 1, 2, 3], [1.0, 2.0, 3.0, 4.0]).drop("row")
    close(column(temporal.lookup(src, dst, ("id", "id"), [("f", "x")])), [None, 1, 2, 3])


def test_lookup_last_of_several_and_null_value(spark):
    src = frame(spark, "id int", [0, 1])
    dst = spark.createDataFrame([(0, 5.0, 1), (0, None, 2), (1, 7.0, 1)], "k int, x double, seq int")
    close(column(temporal.lookup(src, dst, ("id", "k"), [("f", "x")], ["seq"])), [None, 7])


def test_asof_lookup(spark):
    src = frame(spark, "id int, t double", [None, 0, 1, 2], [5.0, 6.0, 7.0, 0.0])
    dst = frame(spark, "id int, t double, x double", [0, 1, 2, 3], [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0])
    close(column(temporal.asof_lookup(src, dst, ("id", "id"), ("t", "t"), ["row"], [("f", "x")])), [None, 1, 2, None])


def test_asof_lookup_null_overwrites_and_ties_are_seen(spark):
    src = frame(spark, "id int, t double", [0, 0], [1.0, 2.0])
    dst = frame(spark, "id int, t double, x double", [0, 0], [1.0, 2.0], [9.0, None])
    close(column(temporal.asof_lookup(src, dst, ("id", "id"), ("t", "t"), ["row"], [("f", "x")])), [9, None])


@pytest.mark.parametrize("mode,want", [("sum", [0, 18, 12, 15, 0]), ("mean", [None, 4.5, 4, 5, None])])
def test_aggregate(spark, mode, want):
    src = frame(spark, "id int", [None, 0, 1, 2, 3])
    dst = frame(spark, "id int, x double", DST, X10)
    close(column(temporal.aggregate(src, dst, ("id", "id"), [("f", "x", mode)])), want)


@pytest.mark.parametrize("mode,want", [("sum", [0, 18, 12, 0, 0]), ("mean", [None, 4.5, 4, None, None])])
def test_asof_aggregate(spark, mode, want):
    src = frame(spark, "id int, t double", [None, 0, 1, 2, 3], [5.0, 6.0, 7.0, 0.0, -1.0])
    dst = frame(spark, "id int, t double, x double", DST, [1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 4.0, 3.0, 2.0, 1.0], X10)
    close(column(temporal.asof_aggregate(src, dst, ("id", "id"), ("t", "t"), ["row"], [("f", "x", mode)])), want)


def test_squash(spark):
    src = frame(spark, "id int", [0, 1, 0, 3, 2, 2, None])
    one = spark.createDataFrame([(0, 4), (1, 3), (2, 2), (3, 1)], "a int, b int")
    close(column(temporal.squash(src, [(one, "a", "b")], "id", "f")), [4, 3, 4, 1, 2, 2, None])


def test_merge_order_ties(spark):
    left = frame(spark, "t double", [0.0, 1.0, 2.0, 5.0])
    right = frame(spark, "t double", [1.0, 2.0, 3.0, 4.0])
    for first, rows, sides in ((True, [0, 1, 0, 2, 1, 2, 3, 3], [1, 1, 0, 1, 0, 0, 0, 1]), (False, [0, 0, 1, 1, 2, 2, 3, 3], [1, 0, 1, 0, 1, 0, 0, 1])):
        got = temporal.merge_order(left, right, "t", first).collect()
        assert [r["row"] for r in got] == rows and [int(r["is_left"]) for r in got] == sides


def three(spark, src0, dst0, src1, dst1, types):
    t0 = frame(spark, "k0 int, t double", src0, [0.5, 0.7, 0.0, 0.9, 0.2, 0.1])
    t1 = frame(spark, "k1 int, k1on int", dst0, src1)
    t2 = frame(spark, "k2 int, x double, t double", dst1, [float(i) for i in range(1, 11)], [i / 10 for i in range(1, 11)])
    rel = [Relation("a", "k0", "b", "k1", types[0]), Relation("b", "k1on", "c", "k2", types[1])]
    cat = Catalog("a", {"a": Table(t0, "row", "t"), "b": Table(t1, "row"), "c": Table(t2, "row", "t")}, rel)
    return cat, Path("a", tuple(rel))


def test_one_many_one(spark):
    cat, path = three(spark, [0, 1, 2, 3, 4, 5], [0, 1, 0, 0, 2, 4, 5, 5], [0, 3, 2, 2, 4, 4, 7, 8], list(range(10)), (MANY, ONE))
    close(column(run(cat, path, "x", "mean", "mean", "f")), [7 / 3, 4, None, None, None, None])
    close(column(run(cat, path, "x", "mean", "mean", "f", inherit_time=False)), [7 / 3, 4, 5, None, 5, 8.5])


def test_many_one_many_is_squashed(spark):
    cat, path = three(spark, [0, 1, 0, 3, 2, 2], [0, 1, 2, 3], [4, 3, 2, 1], [1, 1, 0, 2, 2, 4, 3, 4, 4, 2], (ONE, MANY))
    close(column(run(cat, path, "x", "mean", "mean", "f")), [None, 7, None, 1.5, None, None])
    assert [(h.src, h.dst) for h in hops([True, False], [True, False, True])] == [(0, 2)]


def test_temporal_target_encoding(spark):
    rows = frame(spark, "id int, y double, t int", [0, 1, 1, 0], [1.0, 0.0, 0.0, 1.0], [3, 1, 0, 2])
    close(column(te.temporal(rows, "id", "y", "t", 25, "f")), [13.5 / 26, 12.5 / 26, 0.5, 0.5])


def test_leave_one_out_target_encoding(spark):
    rows = frame(spark, "id int, y double", [0, 1, 1, 0, 0, 1], [1.0, 0.0, 0.0, 1.0, 0.0, 1.0])
    close(column(te.leave_one_out(rows, "id", "y", 20, "f")), [11 / 22] * 4 + [12 / 22, 10 / 22])
    unknown = rows.withColumn("id", F.when(F.col("row") > 1, F.col("id")))
    assert column(te.leave_one_out(unknown, "id", "y", 20, "f"))[0] is None


def test_time_units_round_down(spark):
    rows = frame(spark, "s double", [-1.0, 0.0, 3599.5, 3600.0])
    assert [r[0] for r in rows.select(temporal.time_units(F.col("s"))["hour"]).collect()] == [-1, 0, 0, 1]
