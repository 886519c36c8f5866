"""Dependencies of keys, learned order of candidates, and the way from a catalog to predictions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path, Relation, RelationType, Table
from chronofeat.operators import blocks, selection
from chronofeat.operators.aggregates import grouped
from chronofeat.operators.selection import auc_of
from chronofeat.plans import dependencies, fit
from chronofeat.plans import features as plan
from chronofeat.plans.priority import Priority, spread
from chronofeat.queries import planner

MANY = RelationType.ONE_TO_MANY


def small(spark, n=600, seed=1):
    """People with a target that the mean of their trips' `far` tells; trips know their person's `home`, and their `place` its `zone`."""
    rng = random.Random(seed)
    people, trips, spots = [], [], []
    for i in range(n):
        bad = rng.random() < 0.4
        people.append((i, float(bad) if i % 4 else None, rng.random()))
        for _ in range(rng.randrange(0, 5)):
            place = rng.randrange(20)
            trips.append((len(trips), i, f"h{i % 7}", place, rng.gauss(1.5 * bad, 1), rng.random(), None if rng.random() < 0.1 else "w"))
    for place in range(20):
        for _ in range(3):
            spots.append((len(spots), place, f"z{place % 3}", rng.random()))
    tables = {
        "people": Table(spark.createDataFrame(people, "id int, y double, own double"), "id", None, {"own": "n"}),
        "trips": Table(spark.createDataFrame(trips, "trip int, person int, home string, place int, far double, noise double, only string"), "trip", None, {"home": "c", "far": "n", "noise": "n", "only": "c"}),
        "spots": Table(spark.createDataFrame(spots, "spot int, at int, zone string, size double"), "spot", None, {"zone": "c", "size": "n"}),
    }
    return Catalog("people", tables, [Relation("people", "id", "trips", "person", MANY), Relation("trips", "place", "spots", "at", RelationType.MANY_TO_MANY)], "y")


def test_dependencies_by_brute_force(spark):
    c = small(spark)
    got = {(r["table"], r["key"], r["column"]): (r["keys"], r["varying"]) for r in dependencies.of_catalog(c).collect()}
    want = {}
    for name, (keys, columns) in dependencies.tested(c).items():
        rows = c.tables[name].frame.collect()
        for k in keys:
            for col in columns:
                if k != col:
                    seen = {}
                    for r in rows:
                        if r[k] is not None:
                            seen.setdefault(r[k], set()).add(r[col])
                    want[name, k, col] = (len(seen), sum(len(v - {None}) > 1 for v in seen.values()))
    assert got == want
    assert {("trips", "person", "home"), ("trips", "person", "only"), ("spots", "at", "zone")} <= dependencies.known(c)
    assert ("trips", "person", "far") not in dependencies.known(c)


def test_only_what_no_key_breaks_goes_through_all_rows(spark, monkeypatch):
    c, calls, whole = small(spark), [], dependencies.dependencies

    def seen(frame, keys, columns, some=1):
        calls.append((keys, columns, some))
        return whole(frame, keys, columns, some)

    full = {(r["table"], r["key"], r["column"]) for r in dependencies.of_catalog(c).filter("varying = 0").collect()}
    monkeypatch.setattr(dependencies, "dependencies", seen)
    monkeypatch.setattr(dependencies, "SOME", 2)
    assert dependencies.known(c) == full
    over_all = {(k, x) for keys, columns, some in calls if some == 1 for k in keys for x in columns}
    assert ("person", "home") in over_all and ("person", "far") not in over_all


def test_dependencies_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, 1, None), (None, 2, None), (1, None, None), (1, 3, None), (2, 4, None), (2, 4, None), (3, None, None)], "_k int, key int, `column` int")
    got = {(r["key"], r["column"]): (r["keys"], r["varying"]) for r in dependencies.dependencies(rows, ["_k"], ["key", "column"]).collect()}
    assert got == {("_k", "key"): (3, 0), ("_k", "column"): (3, 0)}
    assert dependencies.dependencies(rows.limit(0), ["_k"], ["key"]).count() == 0


def test_one_pass_for_all_keys(spark):
    plan_ = dependencies.dependencies(small(spark).tables["trips"].frame, ["person", "place"], ["home", "far", "noise"])._jdf.queryExecution().sparkPlan().toString()
    assert plan_.count("Generate") <= 2 and plan_.count("Join") == 0


def test_paths_that_are_to_one_in_substance(spark):
    c = small(spark)
    depends = dependencies.known(c)
    trips = Path("people", (c.relations[0],))
    spots = trips.then(c.relations[1])
    assert dependencies.one_in_substance(trips, "home", depends) and not dependencies.one_in_substance(trips, "far", depends)
    assert not dependencies.one_in_substance(spots, "zone", depends)  # a person's trips go to several places
    assert dependencies.to_many(spots, "zone", depends) == 1 and dependencies.to_many(spots, "size", depends) == 2
    offered = plan.candidates(c, 2, depends=depends)
    kinds = {(f.kind, f.column) for f in offered if f.path == trips}
    assert ("identify", "home") in kinds and ("mode", "home") not in kinds and ("nunique", "home") not in kinds
    assert ("mean", "far") in kinds and ("identify", "far") not in kinds
    assert ("identify", "home") not in {(f.kind, f.column) for f in plan.candidates(c, 2) if f.path == trips}
    home = next(f for f in offered if f.kind == "identify" and f.column == "home")
    got = {r["id"]: r[home.name] for r in plan.build(c, [home]).collect()}
    with_trips = {r["person"] for r in c.tables["trips"].frame.collect()}
    assert got == {i: f"h{i % 7}" if i in with_trips else None for i in range(600)}


def test_priority_learns_what_tells(spark):
    c = small(spark)
    depends = dependencies.known(c)
    offered = plan.candidates(c, 2, depends=depends)
    probe = spread(offered, len(offered) // 2)
    assert len({(f.kind, f.column) for f in probe}) == min(len(probe), len({(f.kind, f.path.end, f.column) for f in offered}))
    p = Priority(c, offered, depends).learn({f: 0.3 if f.column == "far" else 0.01 for f in probe})
    rest = p.ordered([f for f in offered if f not in probe])
    assert all(f in offered for f in rest)
    far = [i for i, f in enumerate(rest) if f.column == "far"]
    assert not far or max(far) < len(rest) / 2
    assert min(p.gain(f) for f in probe if f.column == "far") > max(p.gain(f) for f in probe if f.column == "noise")


def test_selection_falls_back():
    found = {"a": (0.2, 0.4, False), "b": (0.2, 0.35, False), "c": (0.1, 0.01, True), "d": (0.0, 0.0, False), "e": (0.3, 0.45, False)}
    assert fit.chosen(found, 0.5) == ["b", "c"]
    assert fit.chosen(found, 0.0) == ["c"]


def test_fit_and_predict(spark):
    c = small(spark)
    truth = c.tables["people"].frame
    fitted = fit.fit(c, most_hops=1, most=12, iterations=6, folds=3)
    assert any("far" in f for f in fitted.used) and fitted.gains[max(fitted.gains, key=fitted.gains.get)] > 0.1
    out = fit.predict(fitted)
    assert out.columns == ["id", "prediction"] and out.count() == truth.filter("y IS NULL").count()
    rng = random.Random(1)
    hidden = []
    for i in range(600):  # the same draws as small()
        bad = rng.random() < 0.4
        rng.random()
        for _ in range(rng.randrange(0, 5)):
            rng.randrange(20), rng.gauss(0, 1), rng.random(), rng.random()
        hidden.append((i, float(bad)))
    scored = out.join(spark.createDataFrame(hidden, "id int, bad double"), "id")
    assert auc_of(scored, "prediction", "bad").first()["auc"] > 0.75


def test_nothing_to_fit(spark):
    c = small(spark)
    with pytest.raises(ValueError):
        fit.fit(Catalog("people", {"people": Table(c.tables["people"].frame.withColumn("own", F.lit(1.0)), "id")}, [], "y"))


def test_all_candidates_are_built(spark, monkeypatch):
    """Neither the number of rows nor the width of a run leaves a candidate out, and runs don't change what a feature is worth."""
    c = small(spark, 200)
    names = {f.name for f in plan.candidates(c, 1, depends=dependencies.known(c))}
    whole = fit.worth(fit.built(c, plan.candidates(c, 1, depends=dependencies.known(c))), "y")
    monkeypatch.setattr(selection, "feature_limit", lambda train, test: 3)
    monkeypatch.setattr(fit, "WIDE", 9, raising=False)
    fitted = fit.fit(c, most_hops=1, iterations=1, folds=2)
    assert len(names) > 20 and set(fitted.matrix.columns) == {"id", "y", *names}
    assert set(fitted.gains) == set(whole) and all(abs(fitted.gains[n] - whole[n][0]) < 1e-9 for n in whole)
    assert fitted.matrix.count() == 200 and fit.predict(fitted).count() == 50


def test_the_query_takes_all_candidates(spark, monkeypatch):
    def seen(c, most_hops=2, most=None, **_):
        depends = dependencies.known(c)
        assert most is None and len(plan.candidates(c, most_hops, depends=depends)) == len(plan.candidates(c, 5, depends=depends)) > 100
        raise StopIteration

    monkeypatch.setattr(fit, "fit", seen)
    with pytest.raises(StopIteration):
        planner.model_fit(spark, "/root/testdata/sf0.001")


def test_gates_in_one_count_of_values(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(float(rng.random() < 0.4) if i % 4 else None, float(i % 4 == 0), rng.choice([None, float("nan"), float("inf"), *map(float, range(40))]), rng.random(), None) for i in range(400)]
    d = spark.createDataFrame(rows, "y double, t double, a double, b double, none double")
    stored_, counted = selection.stored, []
    monkeypatch.setattr(selection, "stored", lambda *a: counted.append(a) or stored_(*a))
    for size in (1 << 16, 10):
        monkeypatch.setattr(blocks, "BLOCK", size)
        del counted[:]
        got = {r["feature"]: (r["gain"], r["drift"]) for r in selection.gates(d, ["a", "b", "none"], "y", "t").collect()}
        assert len(counted) == 1 and set(got) == {"a", "b"}
        for f in "ab":
            for label, value in zip("yt", got[f], strict=True):
                ok = [(r[2 if f == "a" else 3], r["yt".index(label)]) for r in rows]
                ok = [(x, z) for x, z in ok if z is not None and x is not None and abs(x) < float("inf")]
                pos, neg = [x for x, z in ok if z], [x for x, z in ok if not z]
                auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
                assert abs(value - abs(auc - 0.5)) < 1e-9


@pytest.mark.parametrize("few", [1 << 14, 1])
def test_frequencies_of_many_categories(spark, monkeypatch, few):
    monkeypatch.setattr(fit, "FEW", few, raising=False)
    rows = [(i, float(i % 2), "abc"[i % 3] if i % 5 else None, f"v{i % 7}", float(i)) for i in range(60)]
    out = fit.numbers(spark.createDataFrame(rows, "id int, y double, p string, q string, x double"), "id", "y")
    assert out.columns == ["id", "y", "p", "q", "x"]
    p, q = Counter(r[2] for r in rows), Counter(r[3] for r in rows)
    assert sorted(map(tuple, out.collect())) == [(i, y, float(p[a]), float(q[b]), x) for i, y, a, b, x in rows]
    plan_ = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("Join") == 2 and plan_.count("Relation") == 3  # rows are read once, not once more for each category


def test_distinct_counts_go_apart(spark):
    """Rows are multiplied for distinct counts with the columns that are counted only."""
    rng = random.Random(4)
    rows = [(rng.randrange(9), rng.choice([None, "a", "b", "c"]), rng.random(), rng.random()) for _ in range(200)]
    d = spark.createDataFrame(rows, "k int, v string, x double, other double")
    out = grouped(d, ["k"], [], [("mean", "other", "mean"), ("nunique", "v", "nunique"), ("duplicates", "v", "duplicates"), ("xs", "x", "nunique")])
    for r in out.collect():
        v, x, other = [[row[i] for row in rows if row[0] == r["k"] and row[i] is not None] for i in (1, 2, 3)]
        assert (r["nunique"], r["duplicates"], r["xs"]) == (len(set(v)), len(v) - len(set(v)) if v else None, len(set(x))) and abs(r["mean"] - sum(other) / len(other)) < 1e-12
    multiplied = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Expand" in line]
    assert multiplied and not any("other#" in line for line in multiplied)


def test_what_is_aggregated_joins_after_hops_along_time(spark):
    """Hops along time read main's rows more than once, so items, which these would repeat, are aggregated after them and read once."""
    c = planner.catalog(spark, "/root/testdata/sf0.001")
    some = [f for f in plan.candidates(c, 1) if (f.kind, f.column) in {("mean", "l_quantity"), ("max", "o_totalprice")}]
    some.sort(key=lambda f: f.kind == "max")
    assert [f.column for f in some] == ["l_quantity", "o_totalprice"] and plan.build(c, some)._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet") == 1
