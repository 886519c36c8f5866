"""Runs, divergence of sources and substrings of words against brute force in plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronofeat.llm import debruijn, divergence, runs
from tests.llm.helpers import SCHEMA, docs, empty, rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def all_runs(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_partition_refinement(seed):
    rng = random.Random(seed)
    for _ in range(60):
        some = []
        for _ in range(rng.randrange(1, 6)):
            n, kinds = rng.randrange(70), rng.choice([1, 2, 2, 3, 5, 20])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(2, 9)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            if n and rng.random() < 0.2:
                a, b = [0], [0, 1]
                while len(b) < n:
                    a, b = b, b + a
                w = b[:n]
            some.append(w)
        least = rng.choice([1, 2, 12])
        got = runs.runs_in(np.array(sum(some, []), dtype=np.int64), np.array(list(map(len, some))), least)
        assert list(map(tuple, got.tolist())) == [(d, *r) for d, w in enumerate(some) for r in all_runs(w, least)]


def test_long_runs_are_quick():
    ids = np.random.default_rng(1).integers(0, 3000, 400_000)
    ids[50_000:] = ids[50_000 + np.arange(350_000) % 90_001]
    got = runs.runs_in(ids, np.array([len(ids)]), 12).tolist()
    assert [0, 50_000, 350_000, 90_001] in got and len(got) == 1
    assert runs.runs_in(np.zeros(200_000, dtype=np.int64), np.array([200_000]), 12).tolist() == [[0, 0, 200_000, 1]]


def test_op11(spark, tmp_path):
    repeated = "x " * 40 + "a b c " * 9 + "tail " + "a b a b c " * 12
    more = [(5000 + i, (t or "") + " " + repeated * (i % 3), "en", None, None, "u", "h", "s", "l") for i, (_, t, *_) in enumerate(rows() * 3)]
    spark.createDataFrame(rows() + more, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in [r[:2] for r in rows() + more]:
        w = words(t)
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 2000:  # too long for brute force: its runs by the operator's kernel, tested above
            number = {x: i for i, x in enumerate(set(w))}
            found = [tuple(r[1:]) for r in runs.runs_in(np.array([number[x] for x in w]), np.array([len(w)]), 12).tolist()]
        else:
            found = all_runs(w, 12)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[d, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter(tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect()) == want
    assert sum(k[1] > 0 for k in want) > 20
    assert runs.periodic(empty(spark)).count() == 0


def test_divergence(spark):
    rng = random.Random(4)
    given = [(i, " ".join(rng.choice("la Le DE der 12 é,x É un-der".split()) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "none"]), rng.choice(["a", "b", "ß", None]), None, "u", "h", "s", "l") for i in range(150)]
    given += [(900, "lonely words here", "xx", "one", None, "", "", "", ""), (901, None, "xx", "two", None, "", "", "", ""), (902, "", "en", "wordless", None, "", "", "", "")]
    least, best = 30, 3
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, *_ in given:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = (lang or "", source or "")
        groups.add(g)
        n[g].update(terms)
        held[g[0]].update(set(terms))
    want = []
    for g in groups:
        kept = [t for t, c in held[g[0]].items() if c >= least]
        of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, lang = of(n[g]), of(sum((n[x] for x in groups if x[0] == g[0]), Counter()))
        pair = [(s, sum(abs(mine[t] - q) for t, q in of(n[g[0], s]).items())) for _, s in [x for x in groups if x[0] == g[0] and x != g]]
        term = [(t, mine[t] - lang[t]) for t in kept if n[g][t] and mine[t] > lang[t]]
        for part, items in (("pair", pair), ("term", term)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            want += [(*g, part, x, v, k + 1) for k, (x, v) in enumerate(order) if part == "pair" or k < best]
    pair, term = divergence.divergence(spark.createDataFrame(given, SCHEMA), least, best)
    got = [(r["lang"], r["source"], part, r["item"], r["value"], r["rank"]) for part, d in (("pair", pair), ("term", term)) for r in d.collect()]
    assert sorted(got) == sorted(want)
    assert any(p == "pair" and v for _, _, p, _, v, _ in got) and any(p == "term" for _, _, p, *_ in got)
    assert [d.count() for d in divergence.divergence(empty(spark))] == [0, 0]


@pytest.mark.parametrize("bits", [64, 9])  # nine bits: nearly every name stands for many windows
def test_substrings(spark, bits):
    long = words(rows()[12][1])
    moved = [(700, " ".join(long[4000:4300] + ["between"] + long[100:140]), *rows()[0][2:]), (701, "A b " * 30, *rows()[0][2:]), (702, "a b " * 30, *rows()[0][2:]), (None, " ".join(long[50:90]), *rows()[0][2:])]
    given = [(d, words(t)) for d, t, *_ in rows() + moved]
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, w in given:
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            least[x] = min(least.get(x, key(d)), key(d))
    want = Counter()
    for d, w in given:
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < key(d) for j in range(i, i + 13)}
        want[d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    out = debruijn.deduplicated(docs(spark).unionByName(spark.createDataFrame(moved, SCHEMA)), bits=bits)
    assert Counter(tuple(r) for r in out.collect()) == want
    assert sum(k[2] > 0 for k in want) > 8
    assert debruijn.deduplicated(empty(spark)).count() == 0
