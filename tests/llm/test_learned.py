"""Operators that learn or align: planted cases, and cases that must stay alone."""

import math
import os
import random
import zlib
from collections import Counter

import pytest

from chronofeat.llm import decontaminate, toxicity
from tests.llm.helpers import docs, edited, empty, text


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["vileword", "nastyterm", "hatespew"]
    made, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = text(rng, rng.randrange(30, 300)).split(" ")
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        made.append((i, " ".join(w)))
        labels.append((i, int(toxic), None if i % 50 == 1 else int(toxic)))
    d = toxicity.texts_of(spark.createDataFrame(made, "doc_id long, text string").unionByName(docs(spark).selectExpr("doc_id + 5000 AS doc_id", "text")))
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score_rows(d, model).collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    held = [r for r in out.values() if r["held_out"]]
    assert 100 < len(held) < 260
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert all(r["passages"] for r in held if r["predicted"])


def test_toxicity_against_plain_python(spark):
    rng = random.Random(31)
    made = [(i, " ".join(([text(rng, 20)] + (["vileword hatespew " + text(rng, 2) + " nastyterm"] if i % 4 == 0 else [])) * (1 + i % 3))) for i in range(200)] + [(300, ""), (301, None)]
    d = toxicity.texts_of(spark.createDataFrame(made, "doc_id long, text string"))
    model = toxicity.train(d, spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int"))
    seen = lambda t: toxicity.tokens_of([(t or "").encode()])[0].tolist()
    n, docs_of = {0: Counter(), 1: Counter()}, Counter()
    for i, t in made[:200]:
        if zlib.crc32(str(i).encode()) % 5:
            n[int(i % 4 == 0)].update(seen(t))
            docs_of.update(set(seen(t)) if i % 4 == 0 else [])
    total = {y: sum(c.values()) for y, c in n.items()}
    weight, score = toxicity.PRIOR * min(total.values()), {}
    for w in n[0] | n[1]:
        prior = weight * (n[0][w] + n[1][w]) / (total[0] + total[1])
        a, b = n[1][w] + prior, n[0][w] + prior
        x = math.log(a / (total[1] + weight - a)) - math.log(b / (total[0] + weight - b))
        if abs(x) / math.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z and (docs_of[w] >= toxicity.LEAST_DOCS or x < 0):
            score[w] = max(-toxicity.LARGEST, min(toxicity.LARGEST, x))
    assert len(score) >= 3 and {k: round(v, 9) for k, v in score.items()} == {int(k): round(float(v), 9) for k, v in zip(model["token"], model["score"])}
    got = {r["doc_id"]: r for r in toxicity.score_rows(d, model).collect()}
    for i, t in made:
        s = [score.get(w, -toxicity.COST) for w in seen(t)]
        found = [(a, b, x, -math.log(max(1e-300, 1 - math.exp(-math.exp(model["log_k"] + math.log(len(s)) - model["rate"] * x))))) for a, b, x in brute_segments(s)]
        strong = [f for f in found if f[3] > -math.log(toxicity.SIGNIFICANT)]
        e = max([0.0, sum(f[3] for f in strong), *(f[3] for f in found)])
        p = 1 / (1 + math.exp(-(model["a"] + model["b"] * math.log1p(e))))
        assert abs(got[i]["score"] - p) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert [(x["first"], x["last"]) for x in got[i]["passages"]] == [f[:2] for f in strong]


def test_tokens_beyond_those_that_a_task_holds_reach_their_texts(spark, monkeypatch):
    rng = random.Random(32)
    bad = [f"vile{k}" for k in range(6)]
    made = [(i, " ".join([text(rng, 40)] + (rng.sample(bad, 3) + [text(rng, 9)] + rng.sample(bad, 2) if i % 4 == 0 else []))) for i in range(400)] + [(500, ""), (501, None), (502, "vile0 " * 9000)]
    d = toxicity.texts_of(spark.createDataFrame(made, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    whole = toxicity.train(d, labels)
    assert whole["rest"] is None and len(whole["token"]) >= 6
    order = lambda model: sorted(tuple(r) for r in toxicity.score_rows(d, model).collect())
    want = order(whole)
    monkeypatch.setattr(toxicity, "TASK_TOKENS", 2)
    parts = toxicity.train(d, labels)
    assert len(parts["token"]) == 2 and parts["rest"].count() == len(whole["token"]) - 2
    got = order(parts)
    spans = lambda r: [(x["first"], x["last"], round(x["score"], 6)) for x in r[4]]
    for x, y in zip(got, want, strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 and spans(x) == spans(y)


def test_toxicity_of_held_out_documents(spark):
    """Measured at this size: 0.98 of held-out documents right, where 0.88 are not toxic."""
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    out = toxicity.op7_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").select("score", "predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.96 * len(out)
    order = sorted(out, key=lambda r: r["score"])
    ties, rank, at = Counter(r["score"] for r in out), {}, 0
    for x in sorted(ties):
        rank[x], at = at + (ties[x] + 1) / 2, at + ties[x]
    n1 = sum(r["toxic"] for r in out)
    auc = (sum(rank[r["score"]] for r in order if r["toxic"]) - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1))
    assert auc >= 0.95


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = toxicity.texts_of(docs(spark))
    out = toxicity.score_rows(d, toxicity.train(d, none)).collect()
    assert len(out) == docs(spark).count() and all(r["score"] == 0 and r["predicted"] == 0 for r in out)
    e = toxicity.texts_of(empty(spark))
    assert toxicity.score_rows(e, toxicity.train(e, none)).count() == 0


def brute_segments(scores):
    """All maximal scoring segments: the best one, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 1e-12 and (best is None or s > best[2] + 1e-9):
                best = (i, j, s)
    if best is None:
        return []
    i, j, _ = best
    return brute_segments(scores[:i]) + [best] + [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]


def test_maximal_segments():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, -0.5, 1.25, 2.125, 0.75]) + rng.random() / 1000 for _ in range(rng.randrange(1, 14))]
        total = np.concatenate(([0.0], np.cumsum(scores)))
        p = np.flatnonzero(np.array(scores) > 0)
        got = [(int(p[a]), int(p[b]), round(s, 6)) for a, b, s in toxicity.maximal_segments(total[p], total[p + 1])]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_decontamination(spark):
    rng = random.Random(11)
    items = [text(rng, rng.randrange(20, 60)) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "two words"), (92, "")], "item_id long, text string")
    made, planted = [], set()
    for i in range(200):
        t = text(rng, rng.randrange(20, 400))
        if i % 10 == 0:
            k = rng.randrange(12)
            t = " ".join([text(rng, 30), edited(rng, items[k], rng.choice([0, 0.05, 0.12])), text(rng, 30)])
            planted.add((i, k))
        made.append((i, t))
    made += [(1000 + i, items[3] + " " + text(rng, 50)) for i in range(150)]  # one item in two fifths of all documents
    planted |= {(1000 + i, 3) for i in range(150)}
    d = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs(spark).selectExpr("doc_id + 5000 AS doc_id", "text"))
    out = decontaminate.contaminated(d, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == planted
    assert all(0.5 <= r["score"] <= 1 and 0 <= r["first_word"] <= r["last_word"] < r["text_words"] for r in out)
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0


def test_decontamination_by_short_items(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma delta"), (3, "one two"), (4, "solo"), (5, "?!"), (6, None), (None, "one two")], "item_id long, text string")
    made = [(1, "x Alpha, beta gamma y"), (2, "alpha beta delta gamma"), (3, "alpha beta gamma delta"), (4, "One two."), (5, "one two three"), (6, "solo"), (7, "solo solo"), (8, "?!"), (9, None), (None, "solo")]
    out = decontaminate.contaminated(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in out} == {(1, 1, 1, 3), (3, 1, 0, 2), (3, 2, 0, 3), (4, 3, 0, 1), (4, None, 0, 1), (6, 4, 0, 0), (None, 4, 0, 0)}
    assert len(out) == 7 and all(r["score"] == 1 for r in out)


def test_decontamination_of_edited_copies(spark):
    for seed, copies in ((1, 1), (4, 4), (15, 12)):
        rng = random.Random(seed)
        items = [text(rng, rng.randrange(20, 60)) for _ in range(12)]
        made = [text(rng, rng.randrange(20, 200)) for _ in range(60)]
        made += [" ".join([text(rng, 20), edited(rng, item, 0.2), text(rng, 20)]) for item in items for _ in range(copies)]
        assert not any(item in t for item in items for t in made)
        want, hashes = {}, decontaminate.item_words(items)
        for i, h in enumerate(decontaminate.item_words(made)):
            for k, item in enumerate(hashes):
                score = decontaminate.align(item, h)[0] / (2 * len(item))
                if score >= decontaminate.LEAST:
                    want[i, k] = round(score, 9)
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        out = decontaminate.contaminated(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), bench).collect()
        assert len(want) > 9 * copies
        assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in out} == want
