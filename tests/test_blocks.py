"""Groups cut into blocks against plain sweeps and whole sorts."""

import math
import random

import numpy as np
import pytest

from chronofeat.operators import blocks, temporal
from chronofeat.operators.aggregates import MODES
from chronofeat.operators.medians import kth, medians_of
from pyspark.sql import functions as F
from tests.test_sweep import brute


def test_kth():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 300):
        ranks = rng.permutation(n)
        low = rng.integers(0, n, 200)
        high = low + 1 + (rng.integers(0, n, 200) % (n - low))
        k = rng.integers(0, n, 200) % (high - low)
        assert [sorted(ranks[a:b])[i] for a, b, i in zip(low, high, k)] == kth(ranks, low, high, k).tolist()


def test_medians_of():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 9, 400))
    x = np.where(rng.random(400) < 0.2, np.nan, rng.integers(0, 12, 400).astype(float))
    got = medians_of(group, np.zeros(400, dtype=np.int64), x, np.zeros(400, dtype=np.int64), np.zeros(400, dtype=np.int64))
    for i in range(400):
        seen = [v for g, v in zip(group[: i + 1], x[: i + 1]) if g == group[i] and not math.isnan(v)]
        assert math.isnan(got[i]) if not seen else got[i] == np.median(seen)


@pytest.mark.parametrize("block", [1, 5, 50])
def test_asof_by_blocks(spark, block):
    """One key holds most rows; its blocks carry every mode's state over their edges."""
    rng = random.Random(block)
    key = lambda: rng.choice([None, 0, 0, 0, 0, 0, 0, 1, 2])
    value = lambda: rng.choice([None, 1.0, 2.0, 2.0, 3.0, 5.0, rng.random() * 9])
    dst = [(i, key(), rng.choice([None, *range(12)]), value() if i % 70 > 25 else None) for i in range(320)]
    src = [(i, key(), rng.choice([None, *range(-1, 13)])) for i in range(120)]
    d, s = spark.createDataFrame(dst, "seq int, k int, t int, x double"), spark.createDataFrame(src, "row int, k int, t int")
    out = temporal.asof_aggregate(s, d, ("k", "k"), ("t", "t"), ["seq"], [(m, "x", m) for m in MODES], block=block)
    got = {r["row"]: r for r in out.collect()}
    assert len(got) == len(src)
    for i, k, t in src:
        seen = sorted((u, q, x) for q, j, u, x in dst if k is not None and t is not None and j == k and u is not None and u <= t and x is not None)
        for m in MODES:
            want, have = brute(m, [x for _, _, x in seen]), got[i][m]
            assert (want is None) == (have is None), (i, m, want, have)
            assert want is None or math.isclose(want, have, abs_tol=1e-9), (i, m, want, have)
    last = {r["row"]: r["x"] for r in temporal.asof_lookup(s, d, ("k", "k"), ("t", "t"), ["seq"], [("x", "x")], block=block).collect()}
    for i, k, t in src:
        seen = sorted((u, q) for q, j, u, _ in dst if k is not None and t is not None and j == k and u is not None and u <= t)
        assert last[i] == (dst[seen[-1][1]][3] if seen else None)


def test_hot_key_is_spread(spark):
    rows = spark.range(20_000).select((F.col("id") % 10 < 8).cast("int").alias("k"), (F.col("id") * 7919 % 20_000).alias("t"))
    cut = blocks.cut(rows, ["k"], ["t"], 1000)
    sizes = {(r["k"], r["_block"]): r["count"] for r in cut.on(rows).groupBy("k", "_block").count().collect()}
    assert max(sizes.values()) < 2500 and sum(sizes.values()) == 20_000 and len(sizes) > 15
    assert not blocks.cut(rows, ["k"], ["t"], 9000).split
    total = blocks.running_sum(rows, ["k"], ["t"], F.lit(1), "n", cut)
    place = {0: 0, 1: 0}
    for r in sorted(total.collect(), key=lambda r: r["t"]):
        place[r["k"]] += 1
        assert r["n"] == place[r["k"]]


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.randrange(5), rng.random()]), float(rng.randrange(1000)), None) for _ in range(3000)]
    rows = [(None if a is None else float(a), b, c) for a, b, c in rows]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    for share in (0.0, 0.5, 0.8, 1.0):
        got = blocks.quantiles(d, ["a", "b", "c"], share, 40)
        assert got["c"] is None
        for i, c in enumerate("ab"):
            assert math.isclose(got[c], np.quantile([r[i] for r in rows if r[i] is not None], share), abs_tol=1e-12)


def test_quantiles_order_few_values(spark, monkeypatch):
    """Only values near the quantile are put in order; where the guess misses, all are, with the same result."""
    d = spark.range(20000).selectExpr("CAST((id * 7919) % 20000 AS DOUBLE) AS a")
    seen, whole = [], blocks._quantiles
    monkeypatch.setattr(blocks, "_quantiles", lambda r, *a: seen.append(r.dropna().count()) or whole(r, *a))
    assert blocks.quantiles(d, ["a"], 0.5) == {"a": 9999.5} and seen[0] < 200
    monkeypatch.setattr(blocks, "NEAR", -0.1)
    assert blocks.quantiles(d, ["a"], 0.5) == {"a": 9999.5} and seen[1] == 20000
