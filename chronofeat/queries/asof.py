"""Queries on point-in-time joins and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.operators import temporal
from chronofeat.operators.aggregates import COUNTED, MODES, ZERO

START = "2024-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour since START and a coarse value, which repeats."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = temporal.seconds_since("ts", F.lit(START).cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "value", sec.alias("sec"), F.floor(F.col("value") / 10).cast("double").alias("coarse")).withColumn("hour", F.floor(F.floor("sec") / 3600))


EVENTS_SQL = f"""e AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 1e6 AS sec, floor(value / 10)::DOUBLE AS coarse,
       floor(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 1e6) / 3600) AS hour FROM events)"""


#: Added before results are rounded to 8 decimals: values that end in 5 at the ninth, such as fractions of powers of two, round alike whatever their last bits.
TIE = 3e-11


def typed(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Results as longs where they count and as rounded doubles otherwise."""
    return df.select(*keep, *[F.col(n).cast("long").alias(n) if t == "long" else (F.round(F.col(n).cast("double") + TIE, 8) + 0.0).alias(n) for n, t in names.items()])


#: Over l, the ordered list of values that are not null.
LIST_SQL = {
    "sum": "coalesce(list_sum(l), 0)",
    "variance": "coalesce(list_var_pop(l), 0)",
    "max": "list_max(l)",
    "min": "list_min(l)",
    "mean": "list_avg(l)",
    "median": "list_median(l)",
    "nunique": "coalesce(len(list_distinct(l)), 0)",
    "duplicates": "nullif(len(l), 0) - len(list_distinct(l))",
    "last": "l[-1]",
    "kurtosis": "CASE WHEN list_var_pop(l) > 1e-12 THEN list_avg(list_transform(l, lambda v: pow(v - list_avg(l), 4))) / pow(list_var_pop(l), 2) - 3 END",
    "skewness": "CASE WHEN list_var_pop(l) > 1e-12 THEN list_avg(list_transform(l, lambda v: pow(v - list_avg(l), 3))) / pow(list_var_pop(l), 1.5) END",
    "mode": "list_sort(list_transform(list_distinct(l), lambda v: {'c': len(list_filter(l, lambda w: w = v)), 'p': len(l) - list_position(list_reverse(l), v), 'v': v}))[-1].v",
    "mode_ratio": "list_max(list_transform(list_distinct(l), lambda v: len(list_filter(l, lambda w: w = v)))) / nullif(len(l), 0)::DOUBLE",
    "rolling_sum10": "list_sum(l[-10:])",
    "rolling_mean10": "list_avg(l[-10:])",
    "delay10": "CASE WHEN len(l) >= 10 THEN l[-10] END",
}
COARSE = {"mode", "mode_ratio", "nunique", "duplicates"}


def column_of(mode: str) -> str:
    return "coarse" if mode in COARSE else "value"


def asof_query(mode: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir)
        out = temporal.asof_aggregate(e.select("event_id", "user_id", "hour"), e, ("user_id", "user_id"), ("hour", "hour"), ["sec", "event_id"], [("feature", column_of(mode), mode)])
        return typed(out, {"feature": COUNTED.get(mode, "double")}, ["event_id"])

    return q


def result_sql(mode: str) -> str:
    return f"CAST({LIST_SQL[mode]} AS BIGINT)" if mode in COUNTED else f"round(CAST({LIST_SQL[mode]} AS DOUBLE) + {TIE}, 8) + 0.0"


def asof_sql(mode: str) -> str:
    return f"""WITH {EVENTS_SQL},
p AS (SELECT s.event_id, list(d.{column_of(mode)} ORDER BY d.sec, d.event_id) FILTER (d.{column_of(mode)} IS NOT NULL) AS l
      FROM e s JOIN e d ON d.user_id = s.user_id AND d.hour <= s.hour GROUP BY s.event_id)
SELECT event_id, {result_sql(mode)} AS feature FROM p"""


def batch_query(mode: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
        i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
        out = temporal.aggregate(o, i, ("o_orderkey", "l_orderkey"), [("feature", "l_quantity", mode)], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"])
        return typed(out, {"feature": COUNTED.get(mode, "double")}, ["o_orderkey"])

    return q


def batch_sql(mode: str) -> str:
    return f"""WITH p AS (SELECT o_orderkey, list(l_quantity ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) FILTER (l_quantity IS NOT NULL) AS l
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, {result_sql(mode)} AS feature FROM p"""


def asof_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes of one path in one pass: one exchange and sort of each side."""
    e = events(spark, sf_dir)
    wanted = [(m, column_of(m), m) for m in MODES]
    out = temporal.asof_aggregate(e.select("event_id", "user_id", "hour"), e, ("user_id", "user_id"), ("hour", "hour"), ["sec", "event_id"], wanted)
    return typed(out, {m: COUNTED.get(m, "double") for m in MODES}, ["event_id"])


def asof_all_sql() -> str:
    parts = [f"SELECT event_id, '{m}' AS k, CAST(feature AS DOUBLE) AS v FROM ({asof_sql(m)})" for m in MODES]
    picks = ", ".join(f"CAST(max(v) FILTER (k = '{m}') AS {'BIGINT' if m in COUNTED else 'DOUBLE'}) AS {m}" for m in MODES)
    return f"SELECT event_id, {picks} FROM ({' UNION ALL '.join(parts)}) GROUP BY event_id"


def lookup_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return temporal.lookup(o.select("o_orderkey", "o_custkey"), c, ("o_custkey", "c_custkey"), [("segment", "c_mktsegment")]).select("o_orderkey", "segment")


def lookup_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region"))
    out = temporal.squash(o.select("o_orderkey", "o_custkey"), [(c, "c_custkey", "c_nationkey"), (n, "n_nationkey", "n_regionkey")], "o_custkey", "regionkey")
    return temporal.lookup(out, r, ("regionkey", "r_regionkey"), [("region", "r_name")]).select("o_orderkey", "region")


def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    src = i.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    out = temporal.asof_lookup(src, o, ("l_orderkey", "o_orderkey"), ("l_shipdate", "o_orderdate"), ["o_custkey"], [("status", "o_orderstatus"), ("price", "o_totalprice")])
    return out.drop("l_shipdate")


def asof_count_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("one"))
    out = temporal.asof_aggregate(o, o, ("o_custkey", "o_custkey"), ("o_orderdate", "o_orderdate"), ["o_orderkey"], [("orders_so_far", "one", "sum")])
    return out.select("o_orderkey", F.col("orders_so_far").cast("long").alias("orders_so_far"))


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"))
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("t"))
    from chronofeat.operators.numbering import global_row_number

    both = o.withColumn("src", F.lit(0)).unionByName(i.distinct().withColumn("src", F.lit(1))).distinct()
    return global_row_number(both, ["t", "src", "id"], "place").select("id", "src", F.col("place").cast("long").alias("place"))


def path_query(name: str):
    """region <- nation <- customer: the deepest hop by one mode, the next by another."""
    first, later = PATHS[name]

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        from chronofeat.model import Catalog, Path, Relation, RelationType, Table
        from chronofeat.plans.paths import run

        f = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer")}
        many = RelationType.ONE_TO_MANY
        rel = [Relation("region", "r_regionkey", "nation", "n_regionkey", many), Relation("nation", "n_nationkey", "customer", "c_nationkey", many)]
        cat = Catalog("region", {"region": Table(f["region"], "r_regionkey"), "nation": Table(f["nation"], "n_nationkey"), "customer": Table(f["customer"], "c_custkey")}, rel)
        out = run(cat, Path("region", tuple(rel)), "c_mktsegment" if first == "nunique" else "c_acctbal", first, later)
        return out.select("r_regionkey", F.round(F.col("feature").cast("double"), 6).alias("feature"))

    return q


PATHS = {"path_sum_two_hop": ("sum", "sum"), "path_mean_mean": ("mean", "mean"), "path_mean_variance": ("variance", "mean"), "path_sum_variance": ("variance", "sum"), "path_median": ("mean", "median"), "path_max_max": ("max", "max"), "path_nunique_max": ("nunique", "max"), "path_last_last": ("last", "last")}
AGG_SQL = {"sum": "sum({x})", "mean": "avg({x})", "variance": "var_pop({x})", "median": "median({x})", "max": "max({x})", "nunique": "count(DISTINCT {x})", "last": "arg_max({x}, {o})"}


def path_sql(name: str) -> str:
    first, later = PATHS[name]
    zero = lambda m, x: f"coalesce({x}, 0)" if m in ZERO else x
    a = AGG_SQL[first].format(x="c_mktsegment" if first == "nunique" else "c_acctbal", o="c_custkey")
    b = AGG_SQL[later].format(x="v", o="n_nationkey")
    return f"""WITH h AS (SELECT n_nationkey, n_regionkey, {zero(first, 'max(v)')} AS v FROM nation LEFT JOIN (SELECT c_nationkey, {a} AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1, 2),
g AS (SELECT n_regionkey, {b} AS v FROM h GROUP BY 1)
SELECT r_regionkey, round(CAST({zero(later, 'v')} AS DOUBLE), 6) AS feature FROM region LEFT JOIN g ON n_regionkey = r_regionkey"""


def time_query(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir)
        src = e.select("event_id", "user_id", "hour", "sec")
        if kind == "seq_regression":
            out = temporal.sequential_regression(src, e, ("user_id", "user_id"), ("sec", "sec"), ["event_id"], "value", "slope")
            return out.select("event_id", F.round("slope", 4).alias("feature"))
        value = {"time_diff": "sec", "max_diff_min": "sec", "time_diff_same_table": "gap"}[kind]
        dst = e.withColumn("gap", F.col("sec") - F.col("value"))
        out = temporal.asof_aggregate(src, dst.withColumnRenamed("sec", "dsec").withColumn("sec", F.col("dsec")), ("user_id", "user_id"), ("hour", "hour"), ["sec", "event_id"], [("hi", value, "max"), ("lo", value, "min")])
        x = {"time_diff": F.col("hi") - F.col("sec"), "max_diff_min": F.col("hi") - F.col("lo"), "time_diff_same_table": F.col("hi")}[kind]
        return out.select("event_id", F.round(x, 6).alias("feature"))

    return q


TIME_SQL = {
    "time_diff": "max(d.sec) - s.sec",
    "max_diff_min": "max(d.sec) - min(d.sec)",
    "time_diff_same_table": "max(d.sec - d.value)",
}


def time_sql(kind: str) -> str:
    if kind == "seq_regression":
        return f"WITH {EVENTS_SQL} SELECT s.event_id, round(CASE WHEN var_pop(d.value) > 0 THEN regr_slope(d.sec, d.value) END, 4) AS feature FROM e s JOIN e d ON d.user_id = s.user_id AND d.sec <= s.sec GROUP BY s.event_id"
    return f"WITH {EVENTS_SQL} SELECT s.event_id, round({TIME_SQL[kind]}, 6) AS feature FROM e s JOIN e d ON d.user_id = s.user_id AND d.hour <= s.hour GROUP BY s.event_id, s.sec"


def onehot_query(mode: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        from chronofeat.functions.categorical import most_common, one_hot

        e = events(spark, sf_dir)
        values = [r[0] for r in most_common(e, "event_type", 3).collect()]
        e = one_hot(e, "event_type", values, "is_")
        wanted = [(f"f{i}", f"is_{i}", mode) for i in range(3)]
        out = temporal.asof_aggregate(e.select("event_id", "user_id", "hour"), e, ("user_id", "user_id"), ("hour", "hour"), ["sec", "event_id"], wanted)
        return typed(out, {f"f{i}": "double" for i in range(3)}, ["event_id"])

    return q


def onehot_sql(mode: str) -> str:
    agg = {"mean": "avg", "sum": "sum"}[mode]
    cols = ", ".join(f"round(CAST({agg}(CASE WHEN d.event_type = t{i}.v THEN 1.0 ELSE 0 END) AS DOUBLE) + {TIE}, 8) + 0.0 AS f{i}" for i in range(3))
    tops = ", ".join(f"t{i} AS (SELECT event_type AS v FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1 OFFSET {i})" for i in range(3))
    return f"WITH {EVENTS_SQL}, {tops} SELECT s.event_id, {cols} FROM e s JOIN e d ON d.user_id = s.user_id AND d.hour <= s.hour, t0, t1, t2 GROUP BY s.event_id"


QUERIES = {
    **{f"asof_{m}_events_self": asof_query(m) for m in MODES},
    **{f"agg_{m}_orders_lineitem": batch_query(m) for m in MODES},
    "asof_all_modes_events": asof_all,
    "lookup_customer_segment": lookup_segment,
    "lookup_two_hop_region": lookup_region,
    "asof_lineitem_order_status": asof_status,
    "asof_count_orders_self": asof_count_orders,
    "time_merge_order": merge_order,
    **{n: path_query(n) for n in PATHS},
    **{f"{k}_events": time_query(k) for k in (*TIME_SQL, "seq_regression")},
    "onehot_mean_events": onehot_query("mean"),
    "onehot_sum_events": onehot_query("sum"),
}

SQL = {
    **{f"asof_{m}_events_self": asof_sql(m) for m in MODES},
    **{f"agg_{m}_orders_lineitem": batch_sql(m) for m in MODES},
    "asof_all_modes_events": asof_all_sql(),
    "lookup_customer_segment": "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "lookup_two_hop_region": "SELECT o_orderkey, r_name AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "asof_lineitem_order_status": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, o_orderstatus AS status, o_totalprice AS price FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate",
    "asof_count_orders_self": "SELECT s.o_orderkey, count(*) AS orders_so_far FROM orders s JOIN orders d ON d.o_custkey = s.o_custkey AND d.o_orderdate <= s.o_orderdate GROUP BY s.o_orderkey",
    "time_merge_order": "WITH b AS (SELECT o_orderkey AS id, o_orderdate AS t, 0 AS src FROM orders UNION SELECT l_partkey, l_shipdate, 1 FROM lineitem) SELECT id, src, row_number() OVER (ORDER BY t, src, id) AS place FROM b",
    **{n: path_sql(n) for n in PATHS},
    **{f"{k}_events": time_sql(k) for k in (*TIME_SQL, "seq_regression")},
    "onehot_mean_events": onehot_sql("mean"),
    "onehot_sum_events": onehot_sql("sum"),
}
