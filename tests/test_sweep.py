"""Running aggregates against a plain sweep over random rows with ties and nulls."""

import math
import random
from collections import Counter

from chronofeat.operators import temporal
from chronofeat.operators.aggregates import MODES


def brute(mode, xs):
    if not xs:
        return 0 if mode in ("sum", "variance", "nunique") else None
    n, m = len(xs), sum(xs) / len(xs)
    c = [sum((x - m) ** k for x in xs) / n for k in range(5)]
    s = sorted(xs)
    count, best, top = Counter(), None, 0
    for x in xs:
        count[x] += 1
        if count[x] >= top:
            best, top = x, count[x]
    return {
        "sum": sum(xs), "variance": c[2], "max": max(xs), "min": min(xs), "mean": m, "median": (s[(n - 1) // 2] + s[n // 2]) / 2, "nunique": len(count), "duplicates": n - len(count), "last": xs[-1],
        "mode": best, "mode_ratio": top / n, "kurtosis": c[4] / c[2] ** 2 - 3 if c[2] > 0 else None, "skewness": c[3] / c[2] ** 1.5 if c[2] > 0 else None,
        "rolling_sum10": sum(xs[-10:]), "rolling_mean10": sum(xs[-10:]) / len(xs[-10:]), "delay10": xs[-10] if n >= 10 else None,
    }[mode]


def test_all_modes(spark):
    rng = random.Random(5)
    key = lambda: rng.choice([None, 0, 1, 2, 3])
    dst = [(i, key(), rng.choice([None, *range(12)]), rng.choice([None, 1.0, 2.0, 2.0, 3.0, 5.0])) for i in range(250)]
    src = [(i, key(), rng.choice([None, *range(-1, 13)])) for i in range(90)]
    d = spark.createDataFrame(dst, "seq int, k int, t int, x double")
    s = spark.createDataFrame(src, "row int, k int, t int")
    out = temporal.asof_aggregate(s, d, ("k", "k"), ("t", "t"), ["seq"], [(m, "x", m) for m in MODES])
    got = {r["row"]: r for r in out.collect()}
    assert len(got) == len(src)
    for i, k, t in src:
        seen = sorted((u, q, x) for q, j, u, x in dst if k is not None and t is not None and j == k and u is not None and u <= t and x is not None)
        for m in MODES:
            want, have = brute(m, [x for _, _, x in seen]), got[i][m]
            assert (want is None) == (have is None), (i, m, want, have)
            assert want is None or math.isclose(want, have, abs_tol=1e-9), (i, m, want, have)
