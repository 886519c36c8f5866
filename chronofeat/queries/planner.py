"""Queries on planned features, paths with times, splits and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.functions.scalar import parse_time
from chronofeat.model import Catalog, Path, Relation, RelationType, Table
from chronofeat.operators import selection, temporal
from chronofeat.operators import target_encoding as te
from chronofeat.plans import features as plan
from chronofeat.plans import dependencies, fit, manipulations, paths
from chronofeat.queries import encodings
from chronofeat.queries.asof import TIE
from chronofeat.queries.encodings import O, orders
from chronofeat.session import stored
from chronofeat.sources.tables import model_matrix, read_catalog

TO_ONE, TO_MANY, SELF = RelationType.MANY_TO_ONE, RelationType.ONE_TO_MANY, RelationType.MANY_TO_MANY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c, digits) + 0.0


def derived() -> dict[str, Column]:
    """What items get beside their own columns: a row key, and when they are due."""
    return {"l_row": F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_due": F.expr("l_shipdate + make_interval(0, 0, 0, l_linenumber)")}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders with a target that is unknown for a fifth; their customers, items and the items' parts."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderstatus") == "F").cast("double")))
    i = table(spark, sf_dir, "lineitem")
    i = i.withColumns(derived())
    c = table(spark, sf_dir, "customer").withColumn("words", F.array("c_mktsegment", "c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    tables = {
        "orders": Table(o, "o_orderkey", "o_orderdate", {"o_totalprice": "n", "o_orderpriority": "c"}),
        "customer": Table(c, "c_custkey", None, {"c_acctbal": "n", "c_mktsegment": "c", "words": "m"}),
        "lineitem": Table(i, "l_row", None, {"l_quantity": "n", "l_returnflag": "c", "l_linestatus": "c", "l_shipdate": "t", "l_due": "t"}),
        "part": Table(table(spark, sf_dir, "part"), "p_partkey", None, {"p_brand": "c", "p_size": "n"}),
    }
    rel = [Relation("orders", "o_custkey", "customer", "c_custkey", TO_ONE), Relation("orders", "o_orderkey", "lineitem", "l_orderkey", TO_MANY), Relation("lineitem", "l_partkey", "part", "p_partkey", TO_ONE), Relation("orders", "o_custkey", "orders", "o_custkey", SELF)]
    return Catalog("orders", tables, rel, "y")


def made(path: str, kinds: dict[str, str], digits: int = 6):
    """A query of planned features of a path: name of a kind with its column and detail, and the result's column."""
    return batched({(path, k): (v, digits) for k, v in kinds.items()})


def batched(kinds: dict[tuple[str, str], tuple[str, int]]):
    """A query of planned features of many paths, in one run: path and kind, and the result's column and digits."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        short = {f: (f.path.name, "__".join([f.kind, f.column or "rows", *map(str, f.detail)])) for f in plan.candidates(c, 2)}
        some = [f for f, s in short.items() if s in kinds]
        rows = plan.build(c, some)
        return rows.select("o_orderkey", *[r6(f.name, kinds[short[f]][1]).alias(kinds[short[f]][0]) for f in some])

    return q


ITEMS, PARTS, CUSTOMER, OWN = "orders.lineitem_l_orderkey", "orders.lineitem_l_orderkey.part_p_partkey", "orders.customer_c_custkey", "orders.orders_o_custkey"
Y = "o AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderstatus = 'F')::INT::DOUBLE END AS y FROM orders)"
I = f"{Y}, i AS (SELECT lineitem.*, y FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey), m AS (SELECT avg(y) AS m FROM i)"
BACK = "SELECT o_orderkey, round(avg(e), 6) + 0.0 AS feature FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1"


def loo(key: str, rows: str) -> str:
    return f"""e AS (SELECT l_orderkey, CASE WHEN count(y) OVER w = 0 THEN m ELSE (coalesce(sum(y) OVER w, 0) - coalesce(y, 0) + m * 5) / (count(y) OVER w - (y IS NOT NULL)::INT + 5) END AS e FROM {rows}, m WINDOW w AS (PARTITION BY {key}))"""


def pair_sql() -> str:
    g = lambda n, by: f"coalesce(sum(y) OVER (PARTITION BY {by}), 0) - coalesce(y, 0) AS s{n}, count(y) OVER (PARTITION BY {by}) - (y IS NOT NULL)::INT AS n{n}"
    return f"""WITH {I}, t AS (SELECT l_orderkey, {g(1, 'l_returnflag')}, {g(2, 'l_linestatus')}, {g(3, 'l_returnflag, l_linestatus')} FROM i),
e AS (SELECT l_orderkey, (5 * (s1 / nullif(n1, 0)) + 5 * (s2 / nullif(n2, 0)) + s3 + m * 25) / (n3 + 35) AS e FROM t, m) {BACK}"""


BAG_SQL = f"""WITH {Y}, m AS (SELECT avg(y) AS m FROM o),
w AS (SELECT o_orderkey, y, o_orderdate AS bin, w, count(*)::DOUBLE AS c FROM (SELECT o_orderkey, y, o_orderdate, unnest([c_mktsegment, c_mktsegment, 'n' || c_nationkey]) AS w FROM o JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2, 3, 4),
b AS (SELECT w, bin, coalesce(sum(c * y), 0) AS t, coalesce(sum(c) FILTER (y IS NOT NULL), 0) AS n FROM w GROUP BY 1, 2),
p AS (SELECT x.w, x.bin, coalesce(sum(z.t), 0) AS t, coalesce(sum(z.n), 0) AS n FROM b x LEFT JOIN b z ON z.w = x.w AND z.bin < x.bin GROUP BY 1, 2),
g AS (SELECT bin, sum(t) AS t, sum(n) AS n FROM b GROUP BY 1), h AS (SELECT x.bin, sum(z.t) / nullif(sum(z.n), 0) AS mw FROM g x LEFT JOIN g z ON z.bin < x.bin GROUP BY 1),
r AS (SELECT o_orderkey, sum(c * (t + 5 * mw)) AS num, sum(c * (n + 5)) AS den, bool_or(mw IS NULL) AS none FROM w JOIN p USING (w, bin) JOIN h USING (bin) GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN den IS NULL THEN m WHEN NOT none THEN (num + m * 20) / (den + 20) END, 6) + 0.0 AS feature FROM o LEFT JOIN r USING (o_orderkey), m"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits of customers, at times among those of orders."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 100).alias("v_custkey"), "value", F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(event_id % 2400 as int))").alias("v_time"))


VISITS = "v AS (SELECT event_id, user_id % 100 AS v_custkey, value, TIMESTAMP '1995-01-01' + to_days((event_id % 2400)::INT) AS v_time FROM events)"


def timed_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to their customer, who has no time, to the customer's visits so far."""
    rel = (Relation("orders", "o_custkey", "customer", "c_custkey", TO_ONE), Relation("customer", "c_custkey", "visits", "v_custkey", TO_MANY))
    t = {"orders": Table(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate"), "customer": Table(table(spark, sf_dir, "customer"), "c_custkey"), "visits": Table(visits(spark, sf_dir), "event_id", "v_time")}
    out = paths.run(Catalog("orders", t, list(rel)), Path("orders", rel), "value", "mean", "mean")
    return out.select("o_orderkey", r6(F.col("feature") + TIE).alias("feature"))


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits to the items of a supplier, each at the time of its order, and to the order's price."""
    v = visits(spark, sf_dir).withColumn("v_supp", F.col("event_id") % 10 + 1)
    i = table(spark, sf_dir, "lineitem").withColumn("l_row", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    rel = (Relation("visits", "v_supp", "lineitem", "l_suppkey", SELF), Relation("lineitem", "l_orderkey", "orders", "o_orderkey", TO_ONE))
    t = {"visits": Table(v, "event_id", "v_time"), "lineitem": Table(i, "l_row"), "orders": Table(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")}
    out = paths.run(Catalog("visits", t, list(rel)), Path("visits", rel), "o_totalprice", "max", "max")
    return out.select("event_id", r6("feature").alias("feature"))


TWO_MODES = {"min_min": ("l_quantity", "min", "min"), "duplicates_max": ("l_returnflag", "duplicates", "max"), "mode_mode": ("l_returnflag", "mode", "mode"), "rolling_max": ("l_quantity", "rolling_sum10", "max")}


def two_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to orders to items, by other modes at either hop."""
    rel = (Relation("customer", "c_custkey", "orders", "o_custkey", TO_MANY), Relation("orders", "o_orderkey", "lineitem", "l_orderkey", TO_MANY))
    t = {"customer": Table(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), "orders": Table(table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem": catalog(spark, sf_dir).tables["lineitem"]}
    out = None
    for name, (column, first, later) in TWO_MODES.items():
        one = paths.run(Catalog("customer", t, list(rel)), Path("customer", rel), column, first, later, name)
        out = one if out is None else out.join(one, "c_custkey")
    return out.select("c_custkey", r6("min_min").alias("min_min"), F.col("duplicates_max").cast("long").alias("duplicates_max"), "mode_mode", r6("rolling_max").alias("rolling_max"))


MODE = "list_sort(list_transform(list_distinct(l), lambda v: {'c': len(list_filter(l, lambda w: w = v)), 'p': len(l) - list_position(list_reverse(l), v), 'v': v}))[-1].v"
TWO_MODES_SQL = f"""WITH i AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS l, list(l_quantity ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS q FROM lineitem GROUP BY 1),
h AS (SELECT o_custkey, o_orderkey, list_min(q) AS a, len(l) - len(list_distinct(l)) AS b, {MODE} AS c, list_sum(q[-10:]) AS d FROM orders LEFT JOIN i ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, min(a) AS a, max(b) AS b, list(c ORDER BY o_orderkey) FILTER (c IS NOT NULL) AS l, max(d) AS d FROM h GROUP BY 1)
SELECT c_custkey, round(a, 6) + 0.0 AS min_min, b::BIGINT AS duplicates_max, {MODE} AS mode_mode, round(d, 6) + 0.0 AS rolling_max FROM customer LEFT JOIN g ON o_custkey = c_custkey"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise("never")
    return e.select("event_id", text.alias("t")).select("event_id", F.unix_seconds(parse_time("t", ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"]).cast("timestamp")).alias("seconds"))


H = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT"


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stratified_sample(orders(spark, sf_dir), "o_orderpriority", "o_orderkey", 333).select("o_orderkey", "o_orderpriority")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = selection.random_split(orders(spark, sf_dir).filter("y IS NOT NULL"), "o_orderkey", 0.25).withColumnRenamed("is_valid", "random")
    return selection.stratified_split(o, "y", "o_orderkey", 0.2).select("o_orderkey", "random", F.col("is_valid").alias("stratified"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("is_test", 1 - F.col("is_train"))
    return selection.gates(o, ["o_totalprice", "bin", "grp"], "y", "is_test").select("feature", r6("gain").alias("gain"), r6("drift").alias("drift"), "keep")


AUC = "(sum(r) FILTER (z = 1) - sum(z) * (sum(z) + 1) / 2) / (sum(z) * sum(1 - z))"
RANKED = "SELECT f, z, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 AS r FROM"
GATES_SQL = f"""WITH {O}, f AS (SELECT y, 1 - is_train AS t, unnest([{{'f': 'o_totalprice', 'x': o_totalprice}}, {{'f': 'bin', 'x': bin::DOUBLE}}, {{'f': 'grp', 'x': grp::DOUBLE}}]) AS u FROM o),
a AS (SELECT f, abs({AUC} - 0.5) AS v FROM ({RANKED} (SELECT u.f AS f, u.x AS x, y AS z FROM f WHERE y IS NOT NULL)) GROUP BY 1), b AS (SELECT f, abs({AUC} - 0.5) AS v FROM ({RANKED} (SELECT u.f AS f, u.x AS x, t::DOUBLE AS z FROM f)) GROUP BY 1)
SELECT f AS feature, round(a.v, 6) + 0.0 AS gain, round(b.v, 6) + 0.0 AS drift, a.v > 0.0001 AND b.v <= 0.3 AS keep FROM a JOIN b USING (f)"""


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    n = o.agg(F.sum("is_train").alias("a"), F.sum(1 - F.col("is_train")).alias("b")).first()
    return selection.category_limit(o.filter("y IS NOT NULL"), "y").withColumn("features", F.lit(selection.feature_limit(n["a"], n["b"])).cast("long"))


def user_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mode of the user's own, along time."""
    v = visits(spark, sf_dir)
    out = temporal.asof_aggregate(table(spark, sf_dir, "orders"), v, ("o_custkey", "v_custkey"), ("o_orderdate", "v_time"), ["event_id"], [("feature", "value", "spread")], own={"spread": F.stddev_samp})
    return out.select("o_orderkey", r6("feature").alias("feature"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog read from its folder, with relations, to a model's matrix: categories of over five values stay out."""
    spec = {"orders": {"row": "o_orderkey", "time": "o_orderdate", "roles": {"o_totalprice": "n", "o_orderpriority": "c"}}, "customer": {"row": "c_custkey", "roles": {"c_acctbal": "n", "c_mktsegment": "c", "c_name": "c"}}}
    c = read_catalog(spark, sf_dir, "orders", spec, [{"src": "orders", "src_id": "o_custkey", "dst": "customer", "dst_id": "c_custkey", "type": "many_to_one"}])
    some = [f for f in plan.candidates(c, 1) if f.kind == "identify"]
    rows = plan.build(c, some).select("o_orderkey", *[F.col(f.name).alias(f.column) for f in some])
    return model_matrix(rows, "o_orderkey", ["c_acctbal"], ["c_mktsegment", "c_name"], 5)


def induced_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = te.through(orders(spark, sf_dir), table(spark, sf_dir, "customer"), ("o_custkey", "c_custkey"), "c_mktsegment")
    return te.temporal(o, "c_mktsegment", "y", "bin", 5.0, "feature").select("o_orderkey", r6("feature").alias("feature"))


def in_substance(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog with items that carry their order's priority and their part's brand: of many items, one value by order and by part."""
    c = catalog(spark, sf_dir)
    o, p = c.tables["orders"].frame, c.tables["part"].frame
    items = c.tables["lineitem"]
    rows = items.frame.drop("l_row", "l_due").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("l_priority")).hint("merge"), "l_orderkey", "left")
    rows = rows.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("l_brand")).hint("merge"), "l_partkey", "left")
    rows = stored(rows, "items").withColumns(derived())  # tests of dependencies and features read it
    tables = {**c.tables, "lineitem": Table(rows, items.row, items.time, {**items.roles, "l_priority": "c", "l_brand": "c"})}
    return Catalog(c.main, tables, c.relations, c.target)


def key_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.of_catalog(in_substance(spark, sf_dir)).select("table", "key", "column", "keys", "varying")


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What items determine by their order is looked up along the to-many relation, beside a mean of what they do not."""
    c = in_substance(spark, sf_dir)
    offered = plan.candidates(c, 1, depends=dependencies.known(c))
    names = {("identify", "l_priority"): "priority", ("mean", "l_quantity"): "quantity"}
    some = {f: names[f.kind, f.column] for f in offered if f.path.name == ITEMS and (f.kind, f.column) in names}
    rows = plan.build(c, list(some))
    return rows.select("o_orderkey", *[(r6(f.name) if v == "quantity" else F.col(f.name)).alias(v) for f, v in some.items()])


def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for orders without a target by everything in a row: dependencies, all candidates along all paths of the catalog, gates, bagging."""
    return fit.predict(fit.fit(in_substance(spark, sf_dir), iterations=8))


def dependency_sql() -> str:
    items = ["l_quantity", "l_returnflag", "l_linestatus", "l_shipdate", "l_due", "l_priority", "l_brand", "l_partkey", "l_orderkey"]
    own = ["o_totalprice", "o_orderpriority", "o_custkey", "o_orderkey"]
    parts = [(t, f, k, c) for t, f, keys, cols in (("lineitem", "i", ("l_orderkey", "l_partkey"), items), ("orders", "orders", ("o_custkey",), own)) for k in keys for c in cols if k != c]
    one = lambda t, f, k, c: f"SELECT '{t}' AS \"table\", '{k}' AS key, '{c}' AS \"column\", count(*) AS keys, count(*) FILTER (d > 1) AS varying FROM (SELECT count(DISTINCT {c}) AS d FROM {f} WHERE {k} IS NOT NULL GROUP BY {k})"
    return """WITH i AS (SELECT lineitem.*, l_shipdate + to_days(l_linenumber::INT) AS l_due, o_orderpriority AS l_priority, p_brand AS l_brand
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey)
""" + " UNION ALL ".join(one(*p) for p in parts)


#: Features of five paths and of all builders, run together.
TOGETHER = {
    (PARTS, "target_encoding__p_brand"): ("brand", 6), (PARTS, "hist_encoding__p_size"): ("size", 6), (ITEMS, "factorized_encoding__l_returnflag__l_linestatus"): ("flags", 6),
    (CUSTOMER, "bag_encoding__words"): ("words", 6), ("orders", "target_encoding__o_orderpriority"): ("priority", 6), (OWN, "sequential_regression__o_totalprice"): ("slope", 1),
    (ITEMS, "one_hot_mean__l_returnflag__R"): ("share", 6), (ITEMS, "one_hot_sum__l_returnflag__R"): ("n", 6),
    (ITEMS, "max_diff_min__l_shipdate"): ("span", 6), (ITEMS, "time_diff__l_shipdate"): ("since", 6), (ITEMS, "time_diff_same_table__l_shipdate__l_due"): ("gap", 6),
    (ITEMS, "mean__l_quantity"): ("mean_quantity", 6), (ITEMS, "max__l_quantity"): ("max_quantity", 6), (PARTS, "mean__p_size"): ("mean_size", 6), (PARTS, "max__p_size"): ("max_size", 6),
    (PARTS, "nunique__p_brand"): ("brands", 6), (CUSTOMER, "identify__c_acctbal"): ("acctbal", 6), (OWN, "count__rows"): ("so_far", 6),
}

QUERIES = {
    "key_dependencies": key_dependencies,
    "planned_in_substance": looked_up,
    "model_fit": model_fit,
    "planned_together": batched(TOGETHER),
    "planned_target_encoding": made(PARTS, {"target_encoding__p_brand": "feature"}),
    "planned_target_encoding_timed": made("orders", {"target_encoding__o_orderpriority": "feature"}),
    "planned_factorized_encoding": made(ITEMS, {"factorized_encoding__l_returnflag__l_linestatus": "feature"}),
    "planned_hist_encoding": made(PARTS, {"hist_encoding__p_size": "feature"}),
    "planned_bag_encoding": made(CUSTOMER, {"bag_encoding__words": "feature"}),
    "planned_one_hot": made(ITEMS, {"one_hot_mean__l_returnflag__R": "share", "one_hot_sum__l_returnflag__R": "n"}),
    "planned_time_features": made(ITEMS, {"max_diff_min__l_shipdate": "span", "time_diff__l_shipdate": "since", "time_diff_same_table__l_shipdate__l_due": "gap"}),
    "planned_slope": made(OWN, {"sequential_regression__o_totalprice": "feature"}, 1),
    "path_timed_two_hops": timed_two_hops,
    "path_inherited_time": inherited,
    "path_two_modes": two_modes,
    "parse_time": parsed,
    "stratified_sample": sampled,
    "random_and_stratified_split": split,
    "auc_gates": gated,
    "model_limits": limits,
    "user_aggregate": user_mode,
    "catalog_to_matrix": matrix,
    "te_induced_temporal": induced_temporal,
    "te_adversarial_temporal": encodings.encoded(te.regularized, "grp", "y", "is_train", 40.0, time="bin"),
}
SQL = {
    "key_dependencies": dependency_sql(),
    "planned_in_substance": "SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN any_value(o_orderpriority) END AS priority, round(avg(l_quantity), 6) + 0.0 AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "planned_target_encoding": f"WITH {I}, b AS (SELECT i.*, p_brand FROM i LEFT JOIN part ON p_partkey = l_partkey), {loo('p_brand', 'b')} {BACK}",
    "planned_target_encoding_timed": f"WITH {Y}, m AS (SELECT avg(y) AS m FROM o), b AS (SELECT o_orderpriority AS c, o_orderdate AS t, coalesce(sum(y), 0) AS s, count(y) AS n FROM o GROUP BY 1, 2), p AS (SELECT x.c, x.t, coalesce(sum(z.s), 0) AS s, coalesce(sum(z.n), 0) AS n FROM b x LEFT JOIN b z ON z.c = x.c AND z.t < x.t GROUP BY 1, 2) SELECT o_orderkey, round(CASE WHEN n = 0 THEN m ELSE (s + m * 5) / (n + 5) END, 6) + 0.0 AS feature FROM o JOIN p ON c = o_orderpriority AND t = o_orderdate, m",
    "planned_factorized_encoding": pair_sql(),
    "planned_hist_encoding": f"WITH {I}, b AS (SELECT i.*, CAST(floor((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / greatest(1, (SELECT count(*) FROM lineitem) // 100)) AS BIGINT) AS k FROM i JOIN part ON p_partkey = l_partkey), {loo('k', 'b')} {BACK}",
    "planned_bag_encoding": BAG_SQL,
    "planned_one_hot": "SELECT o_orderkey, round(avg((l_returnflag = 'R')::INT), 6) + 0.0 AS share, coalesce(sum((l_returnflag = 'R')::INT), 0)::DOUBLE AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "planned_time_features": "SELECT o_orderkey, round(max(epoch(l_shipdate)) - min(epoch(l_shipdate)), 6) + 0.0 AS span, round(max(epoch(l_shipdate)) - epoch(any_value(o_orderdate)), 6) + 0.0 AS since, max(-86400.0 * l_linenumber)::DOUBLE AS gap FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "planned_slope": "SELECT s.o_orderkey, round(CASE WHEN var_pop(d.o_totalprice) > 0 THEN regr_slope(epoch(d.o_orderdate) - 8e8, d.o_totalprice) END, 1) + 0.0 AS feature FROM orders s JOIN orders d ON d.o_custkey = s.o_custkey AND d.o_orderdate <= s.o_orderdate GROUP BY 1",
    "path_timed_two_hops": f"WITH {VISITS} SELECT o_orderkey, round(avg(value) + {TIE}, 6) + 0.0 AS feature FROM orders LEFT JOIN v ON v_custkey = o_custkey AND v_time <= o_orderdate GROUP BY 1",
    "path_inherited_time": f"WITH {VISITS}, d AS (SELECT l_suppkey, o_orderdate, max(o_totalprice) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT event_id, round(max(p), 6) + 0.0 AS feature FROM v LEFT JOIN d ON l_suppkey = event_id % 10 + 1 AND o_orderdate <= v_time GROUP BY 1",
    "path_two_modes": TWO_MODES_SQL,
    "parse_time": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('day', ts))::BIGINT END AS seconds FROM events",
    "stratified_sample": f"WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS t FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE r <= ceil(333 * n / t::DOUBLE)",
    "random_and_stratified_split": f"WITH {O}, r AS (SELECT o_orderkey, {H} AS h, row_number() OVER (PARTITION BY y ORDER BY {H}, o_orderkey) AS r, count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS t FROM o WHERE y IS NOT NULL) SELECT o_orderkey, (h < 1073741824)::INT AS random, (r <= ceil(ceil(0.2 * t) * n / t::DOUBLE))::INT AS stratified FROM r",
    "auc_gates": GATES_SQL,
    "model_limits": f"WITH {O} SELECT floor(least(pow(sum(y), 0.3), pow(sum(1 - y), 0.3)))::BIGINT AS \"limit\", (SELECT floor(least(4.5e8 / sum(is_train), 8e8 / count(*), 70 * log10(sum(is_train)) + 200)) FROM o)::BIGINT AS features FROM o WHERE y IS NOT NULL",
    "user_aggregate": f"WITH {VISITS} SELECT o_orderkey, round(stddev_samp(value), 6) + 0.0 AS feature FROM orders LEFT JOIN v ON v_custkey = o_custkey AND v_time <= o_orderdate GROUP BY 1",
    "catalog_to_matrix": "SELECT o_orderkey, c_acctbal, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "te_induced_temporal": f"WITH {O}, a AS (SELECT o.*, c_mktsegment AS c FROM o JOIN customer ON c_custkey = o_custkey), b AS (SELECT c, bin, coalesce(sum(y), 0) AS s, count(y) AS n FROM a GROUP BY 1, 2), p AS (SELECT x.c, x.bin, coalesce(sum(z.s), 0) AS s, coalesce(sum(z.n), 0) AS n FROM b x LEFT JOIN b z ON z.c = x.c AND z.bin < x.bin GROUP BY 1, 2) SELECT o_orderkey, round(CASE WHEN n = 0 THEN m ELSE (s + m * 5) / (n + 5) END, 6) + 0.0 AS feature FROM a JOIN p USING (c, bin), m",
    "te_adversarial_temporal": f"WITH {O}, v AS (SELECT grp FROM o GROUP BY 1 HAVING avg(is_train) BETWEEN 0.01 AND 0.99), b AS (SELECT o.grp, bin, coalesce(sum(CASE WHEN v.grp IS NOT NULL THEN y END), 0) AS s, count(CASE WHEN v.grp IS NOT NULL THEN y END) AS n FROM o LEFT JOIN v ON v.grp = o.grp GROUP BY 1, 2), p AS (SELECT x.grp, x.bin, coalesce(sum(z.s), 0) AS s, coalesce(sum(z.n), 0) AS n FROM b x LEFT JOIN b z ON z.grp = x.grp AND z.bin < x.bin GROUP BY 1, 2) SELECT o_orderkey, round(CASE WHEN n = 0 THEN m ELSE (s + m * 40) / (n + 40) END, 6) + 0.0 AS feature FROM o JOIN p ON p.grp = o.grp AND p.bin = o.bin, m",
}
PARTED = {"planned_target_encoding": "brand", "planned_hist_encoding": "size", "planned_factorized_encoding": "flags", "planned_bag_encoding": "words", "planned_target_encoding_timed": "priority", "planned_slope": "slope"}
PLAIN_SQL = """SELECT s.o_orderkey, round(avg(l_quantity), 6) + 0.0 AS mean_quantity, max(l_quantity)::DOUBLE AS max_quantity, round(avg(p_size), 6) + 0.0 AS mean_size, max(p_size)::DOUBLE AS max_size,
count(DISTINCT p_brand)::DOUBLE AS brands, any_value(c_acctbal)::DOUBLE AS acctbal, (SELECT count(*) FROM orders d WHERE d.o_custkey = s.o_custkey AND d.o_orderdate <= s.o_orderdate)::DOUBLE AS so_far
FROM orders s LEFT JOIN lineitem ON l_orderkey = s.o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = s.o_custkey GROUP BY s.o_orderkey, s.o_custkey, s.o_orderdate"""
SQL["planned_together"] = "SELECT * FROM (" + PLAIN_SQL + ") " + " ".join([f"JOIN (SELECT o_orderkey, feature AS {v} FROM ({SQL[k]})) USING (o_orderkey)" for k, v in PARTED.items()] + [f"JOIN ({SQL[k]}) USING (o_orderkey)" for k in ("planned_one_hot", "planned_time_features")])
