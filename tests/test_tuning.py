"""Search by Parzen estimators against random search, halving, bagging by repeats and times; as-of answers of a stream; walks over a catalog."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Relation, RelationType, Table
from chronofeat.operators import propagate
from chronofeat.plans import learn, tuning
from chronofeat.streaming import asof
from chronofeat.streaming.events import read_stream, run_to_end
from tests.test_learn import rows

SPACE = {"x": tuning.Between(0, 10), "rate": tuning.Between(1e-4, 1.0, log=True), "depth": tuning.Between(1, 12, whole=True), "kind": tuning.Among(("a", "b", "c", "d"))}


def planted(p):
    return -((p["x"] - 7.3) ** 2) / 10 - (math.log10(p["rate"]) + 2.5) ** 2 - (p["depth"] - 5) ** 2 / 8 - (p["kind"] != "c")


def test_finds_a_planted_optimum():
    ours, plain, trials = [], [], 60
    for seed in range(12):
        found = tuning.search(SPACE, lambda some, _: [planted(p) for p in some], trials, 4, (1,), seed=seed)
        assert len(found) == trials and found[0].score == max(t.score for t in found)
        ours.append(found[0].score)
        rng = random.Random(1000 + seed)
        plain.append(max(planted({k: v.draw(rng) for k, v in SPACE.items()}) for _ in range(trials)))
    assert sum(ours) > 0.7 * sum(plain) and sum(a > b for a, b in zip(ours, plain)) >= 10


def test_draws_stay_within_bounds():
    rng = random.Random(1)
    past = [tuning.Trial({k: v.draw(rng) for k, v in SPACE.items()}, 0, rng.random()) for _ in range(30)]
    for _ in range(200):
        p = tuning.propose(SPACE, past, rng)
        assert 0 <= p["x"] <= 10 and 1e-4 <= p["rate"] <= 1 and p["depth"] in range(1, 13) and p["kind"] in "abcd"


def test_halving_stops_weak_trials():
    spent = []

    def evaluate(some, rounds):
        spent.append((len(some), rounds))
        return [planted(p) for p in some]

    found = tuning.search(SPACE, evaluate, 8, 4, (4, 8, 16))
    assert spent == [(4, 4), (2, 8), (1, 16)] * 2
    assert [t.rung for t in found] == sorted((t.rung for t in found), reverse=True) and sum(t.rung == 2 for t in found) == 2


def test_tuned_parameters_go_to_bagging(spark):
    train = rows(spark, 300)
    found = tuning.tune(train, "k", "y", ["x", "z"], {"maxDepth": tuning.Between(1, 3, whole=True)}, 2, 2, None, 2, (1, 2))
    assert found[0].rung == 1 and found[0].score > 0.8
    models = learn.fit_bagged(train, "k", "y", ["x", "z"], folds=2, repeats=2, params=[{**t.params, "maxIter": 2} for t in found])
    assert len(models) == 4 and [m.getMaxDepth() for m in models] == [found[i % 2].params["maxDepth"] for i in range(4)]
    assert len(learn.fit_bagged(train, "k", "y", ["x", "z"], folds=3, iterations=2, time="t")) == 2


@pytest.mark.parametrize("mode", asof.MODES)
def test_stream_is_the_batch(spark, tmp_path, mode):
    rng = random.Random(mode)
    made = [(rng.choice(["a", "b", None]), rng.randrange(0, 20_000), rng.choice([asof.FACT, asof.FACT, asof.ASK]), i, rng.choice([None, 1.0, 2.5, -3.0])) for i in range(120)]
    came = sorted(made, key=lambda r: r[1] + rng.randrange(3000))
    late = [("a", 0, asof.FACT, 900, 1e6), ("a", 1, asof.ASK, 901, None)]  # long after the watermark: dropped
    parts = [came[:40], came[40:80], came[80:], [*late, ("a", 90_000, asof.FACT, 902, 5.0)], [(None, 0, 0, 903, None), ("end", 10**6, asof.FACT, 904, 0.0)]]
    schema = "key string, at long, tag int, id long, value double"
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).withColumn("ts", F.timestamp_seconds("at")).drop("at").write.mode("append").parquet(folder)
    stream = read_stream(spark, folder, spark.read.parquet(folder), files=1)
    out = run_to_end(asof.answered(stream.select("key", "ts", "tag", "id", "value"), mode, "1 hour"), ["id"], "append")
    got = {r["id"]: r["value"] for r in out.collect()}
    want = {}
    for k, t, tag, i, _ in made:
        if tag == asof.ASK and k is not None:
            seen = [x for u, j, x in sorted((u, j, x) for q, u, g, j, x in made if g == asof.FACT and q == k and u <= t and x is not None)]
            n = len(seen)
            want[i] = {"count": n, "sum": sum(seen), "mean": sum(seen) / n if n else None, "max": max(seen, default=None), "min": min(seen, default=None), "last": seen[-1] if n else None}[mode]
    assert got == pytest.approx(want)


def test_keys_share_states(spark, tmp_path):
    """Python is called by bucket, not by key: with one bucket for all keys, answers stay each key's own."""
    made = [(f"k{i % 30}", i, asof.FACT if i < 300 else asof.ASK, i, float(i)) for i in range(330)]
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    for p in (made[:150], made[150:], [("end", 10**6, asof.FACT, 999, 0.0)]):
        spark.createDataFrame(p, "key string, at long, tag int, id long, value double").coalesce(1).withColumn("ts", F.timestamp_seconds("at")).drop("at").write.mode("append").parquet(folder)
    stream = read_stream(spark, folder, spark.read.parquet(folder), files=1)
    out = run_to_end(asof.answered(stream.select("key", "ts", "tag", "id", "value"), "last", "1 hour", buckets=1), ["id"], "append")
    assert {r["id"]: r["value"] for r in out.collect()} == {i: float(i - 30) for i in range(300, 330)}


def test_walk_joins_parents(spark):
    one, many = RelationType.MANY_TO_ONE, RelationType.ONE_TO_MANY
    m = spark.createDataFrame([(0, 1, 1.0, 1), (1, 1, None, 0), (2, 2, 0.0, 1), (3, None, 1.0, 0)], "m int, p int, y double, tr int")
    p = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "p int, q int")
    part = spark.createDataFrame([(10, 0, 7), (11, 0, 8), (12, 3, 7), (13, None, 9)], "part int, m int, q int")
    q = spark.createDataFrame([(7,), (8,), (9,)], "q int")
    far = spark.createDataFrame([(1,)], "far int")
    tables = {"m": Table(m, "m"), "p": Table(p, "p"), "part": Table(part, "part"), "q": Table(q, "q"), "far": Table(far, "far")}
    c = Catalog("m", tables, [Relation("m", "p", "p", "p", one), Relation("m", "m", "part", "m", many), Relation("p", "q", "q", "q", one), Relation("part", "q", "q", "q", one)], "y")
    assert dict(propagate.walk(c)).keys() == {"p", "part", "q"}
    got = propagate.targets_of(c)
    mean = 2 / 3
    tp = {1: (1 + 1000 * mean) / 1001, 2: 1000 * mean / 1001, 3: mean}
    assert {r["p"]: r["_target"] for r in got.tables["p"].frame.collect()} == pytest.approx(tp)
    tpart = {10: 1.0, 11: 1.0, 12: 1.0, 13: None}
    assert {r["part"]: r["_target"] for r in got.tables["part"].frame.collect()} == tpart
    mp, mq = sum(tp.values()) / 3, 1.0
    from_p = {7: (tp[1] + 1000 * mp) / 1001, 8: (tp[2] + 1000 * mp) / 1001, 9: mp}
    from_part = {7: (2 + 1000 * mq) / 1002, 8: (1 + 1000 * mq) / 1001, 9: mq}
    assert {r["q"]: r["_target"] for r in got.tables["q"].frame.collect()} == pytest.approx({k: (from_p[k] + from_part[k]) / 2 for k in from_p})
    assert "_target" not in got.tables["far"].frame.columns
    n = propagate.counts_of(c, "tr")
    assert {r["part"]: (r["n_train"], r["n_all"]) for r in n.tables["part"].frame.collect()} == {10: (1, 1), 11: (1, 1), 12: (0, 1), 13: (0, 0)}
    # From p: shares 1/2 and 1, from part: 1/2 and 1 too; the first parent is kept.
    assert {r["q"]: (r["n_train"], r["n_all"]) for r in n.tables["q"].frame.collect()} == {7: (1, 2), 8: (1, 1), 9: (0, 0)}
