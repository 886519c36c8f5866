"""Features of many paths run together: one exchange and sort a hop, whatever comes through it."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path, Relation, RelationType, Table
from chronofeat.plans import batch, features
from chronofeat.queries import asof, planner

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def exchanges(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().count("Exchange hashpartitioning") + text.getvalue().count("Exchange SinglePartition")


def few(spark):
    many, one = RelationType.ONE_TO_MANY, RelationType.MANY_TO_ONE
    a = spark.createDataFrame([(i, i % 3, i) for i in range(12)], "a int, k int, t int")
    b = spark.createDataFrame([(i, i % 12, i % 5, float(i)) for i in range(60)], "b int, a_id int, c_id int, x double")
    c = spark.createDataFrame([(i, i * 10.0, f"g{i % 2}") for i in range(5)], "c int, y double, g string")
    rel = [Relation("a", "a", "b", "a_id", many), Relation("b", "c_id", "c", "c", one), Relation("a", "k", "a", "k", RelationType.MANY_TO_MANY)]
    return Catalog("a", {"a": Table(a, "a", "t", {"k": "c"}), "b": Table(b, "b", None, {"x": "n"}), "c": Table(c, "c", None, {"y": "n", "g": "c"})}, rel)


def test_exchanges_follow_hops(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        c = few(spark)
        ab, bc, aa = c.relations
        deep, near, own = Path("a", (ab, bc)), Path("a", (ab,)), Path("a", (aa,))
        p = lambda n, path, v, m: batch.Piece(n, path, F.col(v), m, m)
        one = [p("d0", deep, "y", "mean"), p("n0", near, "x", "mean"), p("o0", own, "t", "max")]
        more = [*one, *[p(f"d{i}", deep, "y", m) for i, m in enumerate(("max", "min", "sum"), 1)], *[p(f"n{i}", near, "x", m) for i, m in enumerate(("max", "min", "sum"), 1)], *[p(f"o{i}", own, "t", m) for i, m in enumerate(("min", "sum", "mean"), 1)]]
        assert exchanges(batch.run(c, one)) == exchanges(batch.run(c, more)) > 0
        # The hop from a to b is shared by both paths.
        assert exchanges(batch.run(c, [one[0], one[1]])) == exchanges(batch.run(c, [one[0]]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values(spark):
    c = few(spark)
    ab, bc, aa = c.relations
    got = {r["a"]: r for r in batch.run(c, [batch.Piece("y", Path("a", (ab, bc)), F.col("y"), "sum", "sum"), batch.Piece("x", Path("a", (ab,)), F.col("x"), "max", "max"), batch.Piece("t", Path("a", (aa,)), F.col("t"), "sum", "sum"), batch.Piece("own", Path("a"), F.col("t") * 2, "last", "last")], ["k"]).collect()}
    for a in range(12):
        mine = [i for i in range(60) if i % 12 == a]
        assert got[a]["y"] == sum(i % 5 * 10.0 for i in mine) and got[a]["x"] == max(mine)
        assert got[a]["t"] == sum(t for t in range(a + 1) if t % 3 == a % 3) and got[a]["own"] == 2 * a and got[a]["k"] == a % 3


def test_users_builder(spark, monkeypatch):
    c = few(spark)
    c.modes = {"range": lambda x: F.max(x) - F.min(x)}
    path = Path("a", (c.relations[0],))
    f = features.Feature("reach", path, "x", "range", "range", 1.0)
    g = features.Feature("twice", path, "x", "max", "max", 1.0)
    monkeypatch.setitem(features.BUILDERS, "twice", lambda c, fs: [features.Built(f, [batch.Piece(f.name, f.path, F.col("x") * 2, "max", "max")], F.col(f.name) + F.col("t"), ("t",)) for f in fs])
    got = {r["a"]: (r[f.name], r[g.name]) for r in features.build(c, [f, g]).collect()}
    assert got == {a: (48.0, 2.0 * (48 + a) + a) for a in range(12)}


@needs_tables
def test_builders_take_part(spark):
    """All features of five paths in one run have fewer exchanges than one after the other, and one of each kind more costs no hop."""
    c = planner.catalog(spark, DATA)
    found = {f.name: f for f in features.candidates(c, 2)}
    items = [f for n, f in found.items() if f.path.name == planner.ITEMS and f.kind in ("mean", "max", "one_hot_mean", "one_hot_sum", "max_diff_min", "time_diff", "time_diff_same_table")]
    assert len(items) > 8
    assert exchanges(features.build(c, items)) == exchanges(features.build(c, items[:1]))


@needs_tables
def test_flagship_does_not_change(spark):
    before = asof.asof_all(spark, DATA).columns
    assert planner.QUERIES["user_aggregate"](spark, DATA).count()
    assert asof.asof_all(spark, DATA).columns == before


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """Spark goes by compressed bytes; a table of many rows does not pass the driver, one of few rows may."""
    def plan():
        c = few(spark)
        c.tables["b"] = Table(spark.range(60).selectExpr("CAST(id AS INT) AS b", "CAST(id % 12 AS INT) AS a_id", "CAST(id % 5 AS INT) AS c_id"), "b")
        c.tables["c"] = Table(spark.range(5).selectExpr("CAST(id AS INT) AS c", "id * 10.0D AS y"), "c")
        return batch.run(c, [batch.Piece("y", Path("a", tuple(c.relations[:2])), F.col("y"), "sum", "sum")])._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastExchange" in plan()
    monkeypatch.setattr(batch, "FEW", 3)
    assert "BroadcastExchange" not in plan()


def test_only_keys_that_are_asked_for_are_carried(spark):
    """Rows whose key no row above has are dropped before their time is looked up."""
    many, one = RelationType.MANY_TO_MANY, RelationType.MANY_TO_ONE
    v = spark.createDataFrame([(i, i % 2, i) for i in range(6)], "v int, k int, t int")
    i = spark.createDataFrame([(n, n % 50, n % 7) for n in range(500)], "i int, k int, o int")
    o = spark.createDataFrame([(n, n, n * 10.0) for n in range(7)], "o int, t int, x double")
    rel = [Relation("v", "k", "i", "k", many), Relation("i", "o", "o", "o", one)]
    c = Catalog("v", {"v": Table(v, "v", "t"), "i": Table(i, "i"), "o": Table(o, "o", "t")}, rel)
    out = batch.run(c, [batch.Piece("x", Path("v", tuple(rel)), F.col("x"), "max", "max")])
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
    want = {a: max((n % 7 * 10.0 for n in range(500) if n % 50 == a % 2 and n % 7 <= a), default=None) for a in range(6)}
    assert {r["v"]: r["x"] for r in out.collect()} == want


def test_encodings_of_a_table_share_its_lookups(spark):
    """However many encodings a table has, main is carried to it and its columns are looked up once."""
    c = few(spark)
    c.target = "t"
    found = {f.kind: f for f in features.candidates(c, 2) if f.path.name == "a.b_a_id.c_c" and f.kind.endswith("encoding")}
    scans = lambda *kinds: features.build(c, [found[k] for k in kinds])._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans("target_encoding") == scans("target_encoding", "hist_encoding") > 0
