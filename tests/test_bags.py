"""Encodings of bags of words whose parts are rows."""

import pytest

from chronofeat.operators import target_encoding as te


@pytest.mark.parametrize("time", [None, "t"])
def test_parts_are_never_gathered(spark, monkeypatch, time):
    """A bag given by its parts encodes like the whole bag, also by joins without a broadcast, in tasks whose number follows the rows."""
    bags = [(i, i % 4, float(i % 3 == 0) if i % 5 else None, [f"w{j % 6}" for j in range(i % 7)]) for i in range(60)]
    rows = spark.createDataFrame(bags, "i int, t int, y double, words array<string>")
    parts = spark.createDataFrame([(b[0], b[3][a : a + 2]) for b in bags for a in range(0, len(b[3]), 2)], "i int, words array<string>")
    got = lambda w: {r["i"]: r["f"] and round(r["f"], 9) for r in te.bag(rows, "i", w, "y", 5.0, 20.0, "f", time).collect()}
    want = got("words")
    assert got(parts) == want
    monkeypatch.setattr(te, "FEW", 0)
    monkeypatch.setattr(te, "TASK", 2)
    seen, kept = [], te.stored
    monkeypatch.setattr(te, "stored", lambda d, tag: seen.append(tag == "words" and d.rdd.getNumPartitions()) or kept(d, tag))
    assert got(parts) == want and max(seen) == 30
