"""Folds, search and the whole way from a catalog to predictions; samples by class."""

import random
from functools import reduce

from chronofeat.operators import blocks, selection
from chronofeat.operators.numbering import global_row_number
from chronofeat.plans import learn
from chronofeat.sources.tables import write_predictions


def rows(spark, n=600):
    rng = random.Random(5)
    made = []
    for i in range(n):
        x, z = rng.random(), rng.random()
        made.append((i, float(i), x, z, float(x + 0.3 * rng.random() > 0.9) if i % 10 else None))
    return spark.createDataFrame(made, "k long, t double, x double, z double, y double")


def test_folds_hold_labels_alike(spark):
    known = rows(spark).filter("y IS NOT NULL")
    got = {(r["y"], r["_fold"]): r["count"] for r in learn.folded(known, "k", 3, "y").groupBy("y", "_fold").count().collect()}
    for y in (0.0, 1.0):
        sizes = [got[y, f] for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    times = learn.time_folds(known, "t", 3).groupBy("_fold").agg({"t": "min", "k": "count"}).orderBy("_fold").collect()
    assert [r["_fold"] for r in times] == [0, 1, 2] and times[0]["min(t)"] < times[1]["min(t)"] < times[2]["min(t)"]
    assert max(r["count(k)"] for r in times) <= 1.2 * min(r["count(k)"] for r in times)


def test_search_and_predictions(spark, tmp_path):
    train = rows(spark)
    found = learn.search(train, "k", "y", ["x", "z"], [{"maxDepth": 1, "maxIter": 2}, {"maxDepth": 3, "maxIter": 8}], 2, "t")
    assert len(found) == 2 and found[0][1] >= found[1][1] and found[0][1] > 0.9
    models = learn.fit_bagged(train, "k", "y", ["x", "z"], folds=2, iterations=5)
    out = learn.predict(models, train.filter("y IS NULL"), ["x", "z"])
    write_predictions(out.select("k", "prediction"), f"{tmp_path}/predictions")
    back = spark.read.parquet(f"{tmp_path}/predictions").join(train.selectExpr("k", "cast(x > 0.75 AS int) AS sure"), "k")
    assert back.count() == 60 and selection.auc_of(back, "prediction", "sure").first()["auc"] > 0.95


def test_samples_keep_rare_classes(spark):
    d = spark.createDataFrame([(i, int(i < 10)) for i in range(1000)], "k long, y int")
    got = {r["y"]: r["count"] for r in selection.stratified_sample(d, "y", "k", 100).groupBy("y").count().collect()}
    assert got == {0: 99, 1: 1}
    assert selection.stratified_sample(d.limit(0), "y", "k", 100).count() == 0


def test_row_numbers_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 50)
    for make in (lambda i: f"s{i:05d}", lambda i: 2**60 + i, lambda i: i / 7):
        values = [make(i * 37 % 1000) for i in range(1000)]
        d = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, 1000)], f"v {'string' if isinstance(values[0], str) else 'long' if isinstance(values[0], int) else 'double'}, i int")
        got = sorted((r["n"], r["v"]) for r in global_row_number(d, ["v", "i"], "n").collect() if r["v"] is not None)
        assert [n for n, _ in got] == list(range(2, 1002)) and [v for _, v in got] == sorted(values)


def test_log_pairs_go_by_different_rows(spark, monkeypatch):
    """Rows that are alike are counted once before pairs of numbers are made of them, and weigh as many."""
    rows = [(i % 2, float(i % 3), float(i % 5 + i % 2), 0.5) for i in range(30)]
    d = spark.createDataFrame(rows, "y int, a double, b double, c double")
    seen = []
    whole = selection.auc_table
    monkeypatch.setattr(selection, "auc_table", lambda r, *a: seen.append(r.count()) or whole(r, *a))
    few, many = (sorted(map(tuple, selection.log_pair_gain(x, ["a", "b", "c"], "y", -1.0).collect())) for x in (d, reduce(type(d).unionAll, [d] * 7)))
    assert seen == [len(set(rows))] * 2 and few == many and len(few) == 6


def test_row_numbers_are_sorted_once(spark):
    """Numbers come from places within written ranges: what is left to do has no sort of the rows."""
    d = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v", "id AS i")
    out = global_row_number(d, ["v", "i"], "n", 300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort [v" not in plan and "Scan parquet" in plan
    assert sorted((r["v"], r["n"]) for r in out.collect()) == [(i, i + 1) for i in range(5000)]


def test_models_are_fitted_together(spark, monkeypatch):
    """Two models' jobs run at once: each waits for the other to begin."""
    import threading

    both = threading.Barrier(2, timeout=30)

    def waits(data, k, past, **params):
        both.wait()
        return params["maxDepth"] + k / 10

    monkeypatch.setattr(learn, "held_out", waits)
    d = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(40)], "k long, y double, x double")
    assert learn.search(d, "k", "y", ["x"], [{"maxDepth": 1}, {"maxDepth": 2}], 2) == [({"maxDepth": 2}, 2.05), ({"maxDepth": 1}, 1.05)]
