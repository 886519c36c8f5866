"""Queries on single-table features, statistics, selection and planning, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.functions import categorical as cat
from chronofeat.functions import scalar
from chronofeat.model import Catalog, Relation, RelationType, Table
from chronofeat.operators import propagate, selection, temporal
from chronofeat.plans import features as plan
from chronofeat.plans import learn, stats, tuning
from chronofeat.queries import encodings
from chronofeat.queries.asof import EVENTS_SQL, TIE, events
from chronofeat.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return e.select("event_id", *[v.cast("int").alias(k) for k, v in scalar.calendar(F.col("ts")).items()], r6(temporal.seconds_since("ts", F.lit("2024-01-01").cast("timestamp"))).alias("seconds"))


def time_parts_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the parts that a month of events allows: no year, no day of year."""
    out = scalar.calendar_features(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    return out.select("event_id", *[F.col(c).cast("int").alias(c) for c in out.columns[2:]])


def freq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.frequency(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "freq").select("p_partkey", "p_brand", "freq")


def null_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.col("o_custkey").alias("cust"))
    return scalar.null_flags(o, ["price", "cust"]).select("o_orderkey", "price_is_null")


def constant_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    return scalar.without_constants(o, ["o_totalprice", "same", "none"])


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.label_encode(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["p_partkey"], "label").select("p_partkey", F.col("label").cast("long").alias("label"))


def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.most_common(table(spark, sf_dir, "part"), "p_brand", 5)


def is_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", cat.is_value("o_orderstatus", "F").alias("is_f"))


def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return temporal.trailing_count(e, "event_type", ["ts", "event_id"], 50, "recent").select("event_id", "recent")


def log_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", r6(scalar.log_pair("l_quantity", "l_extendedprice")).alias("plus"), r6(scalar.log_pair("l_quantity", "l_extendedprice", -1)).alias("minus"))


def rank_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.rank_bucket(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "bucket").select("p_partkey", F.col("bucket").cast("long").alias("bucket"))


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of each user and day, comma-joined."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("bag"))


BAGS = "b AS (SELECT user_id, ts::DATE AS day, list_sort(list(event_type)) AS l FROM events GROUP BY 1, 2), c AS (SELECT user_id, day, w, count(*) AS n FROM (SELECT user_id, day, unnest(l) AS w FROM b) GROUP BY 1, 2, 3)"


def bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cat.bag_features(cat.words("bag"))
    return bags(spark, sf_dir).select("user_id", "day", *[v.alias(k) if k == "mode" else v.cast("long").alias(k) for k, v in f.items()])


def bow_part(name: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bow(spark, sf_dir).select("user_id", "day", name)

    return q


def bow_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    return cat.top_word_counts(b, cat.words("bag"), 10).select("user_id", "day", *[F.col(f"count_{i}").cast("long").alias(f"count_{i}") for i in range(10)])


def bow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cat.bag_statistics(bags(spark, sf_dir), cat.words("bag"))
    return s.select(F.col("total_words").cast("long").alias("total_words"), F.col("max_words").cast("long").alias("max_words"), r6(F.col("mean_words")).alias("mean_words"), "unique_words")


def bow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir).withColumn("y", (F.col("user_id") % 2).cast("long"))
    return cat.word_labels(b, cat.words("bag"), "y")


def bow_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir).withColumn("row", F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")))
    return cat.count_matrix(b, "row", cat.words("bag"))


def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("bag"))
    return cat.tf_idf(p, "p_partkey", F.col("bag")).select("p_partkey", "word", r6(F.col("weight")).alias("weight"))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = encodings.orders(spark, sf_dir)
    return selection.auc_table(o, ["o_totalprice", "grp", "bin"], "y").select("feature", r6(F.col("auc")).alias("auc"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = encodings.orders(spark, sf_dir).withColumn("is_test", 1 - F.col("is_train"))
    d = selection.selected(selection.drift(o, ["o_totalprice", "bin"], ["o_orderpriority"], "is_test"))
    return d.select("feature", r6(F.col("auc")).alias("auc"), r6(F.col("std_ratio")).alias("std_ratio"), r6(F.col("nunique_ratio")).alias("nunique_ratio"), "keep")


def log_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return selection.log_pair_gain(i, ["l_quantity", "l_extendedprice", "l_discount"], "y", -1.0).select("a", "b", "sign", r6(F.col("gain")).alias("gain"))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.time_split(events(spark, sf_dir).select("event_id", "sec"), "sec").select("event_id", "is_valid")


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag", "l_quantity", "l_linenumber"])


def substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("half", F.col("o_custkey") % 2)
    return stats.constant_per_key(o, "o_custkey", ["half", "o_orderstatus", "o_totalprice"])


def group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_group_size(table(spark, sf_dir, "lineitem"), "l_orderkey")


def self_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.self_relations(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderkey"])


def class_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_limits(encodings.orders(spark, sf_dir), "y").select("minority", r6(F.col("max_categories")).alias("max_categories"))


def union_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofeat.sources.tables import train_and_test

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return train_and_test(o.filter("o_orderkey % 5 <> 0"), o.filter("o_orderkey % 5 = 0").drop("y"), "y")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "lineitem")}
    items = t["lineitem"].withColumn("l_row", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    tables = {
        "orders": Table(t["orders"], "o_orderkey", "o_orderdate", {"o_totalprice": "n", "o_orderstatus": "c"}),
        "customer": Table(t["customer"], "c_custkey", None, {"c_acctbal": "n", "c_mktsegment": "c"}),
        "nation": Table(t["nation"], "n_nationkey", None, {"n_name": "c"}),
        "lineitem": Table(items, "l_row", None, {"l_quantity": "n", "l_returnflag": "c"}),
    }
    rel = [
        Relation("orders", "o_custkey", "customer", "c_custkey", RelationType.MANY_TO_ONE),
        Relation("customer", "c_nationkey", "nation", "n_nationkey", RelationType.MANY_TO_ONE),
        Relation("orders", "o_orderkey", "lineitem", "l_orderkey", RelationType.ONE_TO_MANY),
        Relation("orders", "o_custkey", "orders", "o_custkey", RelationType.MANY_TO_MANY),
    ]
    return Catalog("orders", tables, rel)


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the orders catalog, with costs."""
    found = plan.candidates(catalog(spark, sf_dir), 2)
    return spark.createDataFrame([(f.name, f.kind, f.first, f.later, float(f.cost)) for f in found], "name string, kind string, first string, later string, cost double")


def chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    c = catalog(spark, sf_dir)
    want = {"identify__orders_customer_c_custkey__c_acctbal", "identify__orders_customer_c_custkey__c_mktsegment", "mean__orders_lineitem_l_orderkey__l_quantity", "max__orders_lineitem_l_orderkey__l_quantity", "nunique__orders_lineitem_l_orderkey__l_returnflag", "count__orders_orders_o_custkey__rows", "sum__orders_orders_o_custkey__o_totalprice"}
    some = [f for f in plan.candidates(c, 2) if f.name in want]
    return plan.build(c, some), [f.name for f in some]


SHORT = {"identify__orders_customer_c_custkey__c_acctbal": "acctbal", "identify__orders_customer_c_custkey__c_mktsegment": "segment", "mean__orders_lineitem_l_orderkey__l_quantity": "mean_quantity", "max__orders_lineitem_l_orderkey__l_quantity": "max_quantity", "nunique__orders_lineitem_l_orderkey__l_returnflag": "flags", "count__orders_orders_o_custkey__rows": "orders_so_far", "sum__orders_orders_o_custkey__o_totalprice": "last_ten"}


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = chosen(spark, sf_dir)
    return out.select("o_orderkey", *[(F.col(a) if b == "segment" else r6(F.col(a).cast("double"))).alias(b) for a, b in SHORT.items()])


def fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = chosen(spark, sf_dir)
    o = encodings.orders(spark, sf_dir)
    numbers = [n for n in names if n != "identify__orders_customer_c_custkey__c_mktsegment"]
    # Folds, models and predictions read it.
    rows = stored(o.select("o_orderkey", "y", "bin", "o_totalprice").join(out.select("o_orderkey", *numbers), "o_orderkey"), "features")
    feats = [*numbers, "bin", "o_totalprice"]
    models = learn.fit_bagged(rows, "o_orderkey", "y", feats)
    return learn.predict(models, rows.filter("y IS NULL"), feats).select("o_orderkey", "prediction")


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out AUC of two depths of trees, over stratified folds and over folds of time."""
    o = encodings.orders(spark, sf_dir)
    grid, out = [{"maxDepth": 2, "maxIter": 8}, {"maxDepth": 4, "maxIter": 8}], []
    for kind, time in (("stratified", None), ("time", "bin")):
        out += [(kind, p["maxDepth"], float(a)) for p, a in learn.search(o, "o_orderkey", "y", ["o_totalprice", "bin", "grp"], grid, 3, time)]
    return spark.createDataFrame(out, "folds string, depth int, auc double")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows per event type by a stream that is run until its input ends."""
    from chronofeat.streaming.events import read_stream, run_to_end, windowed

    s = windowed(read_stream(spark, sf_dir, table(spark, sf_dir, "events"), "events.parquet"), "event_type", "ts", "value")
    return run_to_end(s, ["event_type", "start"]).select("event_type", F.unix_seconds("start").alias("start"), "n", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"), "last")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    idf = cat.fit_idf(p, "p_partkey", F.col("w"), 64)
    out = cat.hashed_tf_idf(p, "p_partkey", F.col("w"), idf, 64)
    return out.select("p_partkey", F.explode(F.arrays_zip("indices", "values")).alias("c")).select("p_partkey", F.col("c.indices").alias("bucket"), r6(F.col("c.values")).alias("weight"))


def heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return cat.heaviest_word(cat.tf_idf(p, "p_partkey", F.col("w")), "p_partkey").select("p_partkey", "word", r6(F.col("weight")).alias("weight"))


#: Rows of all batches for each file of a batch.
ROWS = 1 << 20


def asof_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a user's values so far, at each event, by a stream that gets events in several batches, a tenth of them up to two hours late."""
    from chronofeat.session import shared_folder
    from chronofeat.streaming import asof
    from chronofeat.streaming.events import read_stream, run_to_end

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    came = F.unix_seconds("ts") + F.when(F.col("event_id") % 10 == 0, F.pmod(F.xxhash64("event_id"), F.lit(7000))).otherwise(0)
    ends = e.agg(F.min(came).alias("a"), F.max(came).alias("b"), F.count(F.lit(1)).alias("n")).first()
    step = ((ends["b"] or 0) - (ends["a"] or 0)) // 3 + 1
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    files = 1 + ends["n"] // ROWS  # a batch's
    for part in range(3):  # in the order in which they came
        e.filter((came >= (ends["a"] or 0) + part * step) & (came < (ends["a"] or 0) + (part + 1) * step)).repartition(files).write.mode("append").parquet(folder)
    # A row of nobody's, long after, lets the watermark pass all others.
    e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.coalesce("ts", F.current_timestamp()) + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(0.0).alias("value")).select(*[F.col(c).cast(t) for c, t in e.dtypes]).coalesce(1).write.mode("append").parquet(folder)
    stream = read_stream(spark, folder, e, files=files)
    rows = asof.sides(stream, stream, ("user_id", "user_id"), ("ts", "ts"), ("event_id", "event_id"), "value")
    out = run_to_end(asof.answered(rows, "mean", "2 hours"), ["id"], "append")
    return out.filter("id >= 0").select(F.col("id").alias("event_id"), r6(F.col("value") + TIE).alias("feature"))


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a search of trees by Parzen estimators with halving, best first."""
    o = encodings.orders(spark, sf_dir)
    space = {"maxDepth": tuning.Between(1, 5, whole=True), "stepSize": tuning.Between(0.02, 0.5, log=True), "subsamplingRate": tuning.Among((0.6, 0.8, 1.0))}
    found = tuning.tune(o, "o_orderkey", "y", ["o_totalprice", "bin", "grp"], space, 4, 2, "bin", 2, (2, 4))
    return spark.createDataFrame([(i, t.params["maxDepth"], float(t.params["stepSize"]), float(t.params["subsamplingRate"]), t.rung, float(t.score)) for i, t in enumerate(found)], "place int, depth int, step double, share double, rung int, auc double")


def sales(spark: SparkSession, sf_dir: str) -> Catalog:
    """Items with their customer and supplier, both of whom have a nation: it is reached by two parents."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = i.join(o.hint("merge"), i["l_orderkey"] == o["o_orderkey"]).select(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("s_row"), F.col("o_custkey").alias("s_custkey"), F.col("l_suppkey").alias("s_suppkey"), (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("is_train"))
    t = {"sales": Table(s, "s_row"), "customer": Table(table(spark, sf_dir, "customer"), "c_custkey", None, {"c_acctbal": "n", "c_mktsegment": "c"}), "supplier": Table(table(spark, sf_dir, "supplier"), "s_suppkey", None, {"s_acctbal": "n"}), "nation": Table(table(spark, sf_dir, "nation"), "n_nationkey")}
    one = RelationType.MANY_TO_ONE
    rel = [Relation("sales", "s_custkey", "customer", "c_custkey", one), Relation("sales", "s_suppkey", "supplier", "s_suppkey", one), Relation("customer", "c_nationkey", "nation", "n_nationkey", one), Relation("supplier", "s_nationkey", "nation", "n_nationkey", one)]
    return Catalog("sales", t, rel, "y")


def each_table(c: Catalog, columns: list[Column]) -> DataFrame:
    """Columns of all tables but main, by table and key."""
    parts = [c.tables[t].frame.select(F.lit(t).alias("tab"), F.col(c.tables[t].row).cast("long").alias("key"), *columns) for t in ("customer", "supplier", "nation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_table(propagate.targets_of(sales(spark, sf_dir)), [r6(F.col("_target")).alias("target")])


def propagated_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = propagate.targets_of(sales(spark, sf_dir), surrogates=True)
    return c.tables["supplier"].frame.select("s_suppkey", r6(F.col("_target")).alias("target"))


def propagated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_table(propagate.counts_of(sales(spark, sf_dir), "is_train"), [F.col("n_train"), F.col("n_all")])


SALES = "s AS (SELECT o_custkey AS c, l_suppkey AS p, (l_returnflag = 'R')::INT::DOUBLE AS y, (l_linenumber % 3 = 0)::INT AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
CARRIED = f"""{SALES}, m AS (SELECT avg(y) AS m FROM s),
c AS (SELECT c_custkey AS k, any_value(c_nationkey) AS n, (coalesce(sum(y), 0) + 1000 * any_value(m)) / (count(y) + 1000) AS v FROM customer LEFT JOIN s ON c = c_custkey, m GROUP BY 1),
u AS (SELECT s_suppkey AS k, any_value(s_nationkey) AS n, (coalesce(sum(y), 0) + 1000 * any_value(m)) / (count(y) + 1000) AS v FROM supplier LEFT JOIN s ON p = s_suppkey, m GROUP BY 1),
a AS (SELECT n_nationkey AS k, (coalesce(sum(v), 0) + 1000 * (SELECT avg(v) FROM c)) / (count(v) + 1000) AS v FROM nation LEFT JOIN c ON c.n = n_nationkey GROUP BY 1),
b AS (SELECT n_nationkey AS k, (coalesce(sum(v), 0) + 1000 * (SELECT avg(v) FROM u)) / (count(v) + 1000) AS v FROM nation LEFT JOIN u ON u.n = n_nationkey GROUP BY 1)"""
PROPAGATED_SQL = f"""WITH {CARRIED} SELECT 'customer' AS tab, k::BIGINT AS key, round(v, 6) + 0.0 AS target FROM c UNION ALL SELECT 'supplier', k, round(v, 6) + 0.0 FROM u UNION ALL SELECT 'nation', a.k, round((a.v + b.v) / 2, 6) + 0.0 FROM a JOIN b USING (k)"""
COUNTED_SQL = f"""WITH {SALES}, c AS (SELECT c_custkey AS k, any_value(c_nationkey) AS n, coalesce(sum(t), 0) AS t, count(c) AS a FROM customer LEFT JOIN s ON c = c_custkey GROUP BY 1),
u AS (SELECT s_suppkey AS k, any_value(s_nationkey) AS n, coalesce(sum(t), 0) AS t, count(p) AS a FROM supplier LEFT JOIN s ON p = s_suppkey GROUP BY 1),
x AS (SELECT n_nationkey AS k, coalesce(sum(t), 0) AS t, coalesce(sum(a), 0) AS a FROM nation LEFT JOIN c ON c.n = n_nationkey GROUP BY 1), y AS (SELECT n_nationkey AS k, coalesce(sum(t), 0) AS t, coalesce(sum(a), 0) AS a FROM nation LEFT JOIN u ON u.n = n_nationkey GROUP BY 1),
w AS (SELECT (SELECT coalesce(stddev_pop(t / nullif(a, 0)::DOUBLE), -1) FROM x) >= (SELECT coalesce(stddev_pop(t / nullif(a, 0)::DOUBLE), -1) FROM y) AS w)
SELECT 'customer' AS tab, k::BIGINT AS key, t::BIGINT AS n_train, a::BIGINT AS n_all FROM c UNION ALL SELECT 'supplier', k, t, a FROM u UNION ALL SELECT 'nation', x.k, CASE WHEN w THEN x.t ELSE y.t END, CASE WHEN w THEN x.a ELSE y.a END FROM x JOIN y USING (k), w"""
SURROGATES_SQL = f"""WITH {CARRIED}, f AS (SELECT s_suppkey, (s_acctbal > (SELECT median(s_acctbal) FROM supplier))::INT AS x, (v > (SELECT avg(v) FROM u))::INT AS z, v FROM supplier JOIN u ON k = s_suppkey),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM f), g AS (SELECT abs((sum(r) FILTER (z = 1) - sum(z) * (sum(z) + 1) / 2) / nullif(sum(z) * sum(1 - z), 0) - 0.5) AS d FROM r)
SELECT s_suppkey, round(CASE WHEN d > 0 THEN x ELSE v END, 6) + 0.0 AS target FROM f, g"""
PLAN_SQL = """WITH p(path, hops, many, tab, timed) AS (VALUES ('orders', 0, false, 'orders', true), ('orders_customer_c_custkey', 1, false, 'customer', false), ('orders_customer_c_custkey_nation_n_nationkey', 2, false, 'nation', false),
  ('orders_lineitem_l_orderkey', 1, true, 'lineitem', false), ('orders_orders_o_custkey', 1, true, 'orders', true)),
c(tab, col, role) AS (VALUES ('orders', 'o_totalprice', 'n'), ('orders', 'o_orderstatus', 'c'), ('customer', 'c_acctbal', 'n'), ('customer', 'c_mktsegment', 'c'), ('nation', 'n_name', 'c'), ('lineitem', 'l_quantity', 'n'), ('lineitem', 'l_returnflag', 'c')),
k(kind, first, later, role, more) AS (VALUES ('duplicates', 'duplicates', 'max', 'c', 0.5), ('last', 'last', 'last', 'nc', 0.5), ('max', 'max', 'max', 'n', 0), ('min', 'min', 'min', 'n', 0), ('mean', 'mean', 'mean', 'n', 0), ('mean_variance', 'variance', 'mean', 'n', 0),
  ('sum_variance', 'variance', 'sum', 'n', 0), ('median', 'mean', 'median', 'n', 0), ('mode', 'mode', 'mode', 'c', 0.5), ('nunique', 'nunique', 'max', 'c', 0.5), ('sum', 'rolling_sum10', 'max', 'n', 0.5)),
v(tab, col, val) AS (SELECT DISTINCT 'lineitem', 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT DISTINCT 'orders', 'o_orderstatus', o_orderstatus FROM orders),
a AS (SELECT kind || '__' || path || '__' || col AS name, kind, first, later, hops + more AS cost FROM p JOIN c USING (tab) JOIN k ON contains(k.role, c.role) WHERE many
UNION ALL SELECT 'count__' || path || '__rows', 'count', 'sum', 'sum', hops FROM p WHERE many
UNION ALL SELECT 'identify__' || path || '__' || col, 'identify', 'last', 'last', hops FROM p JOIN c USING (tab) WHERE NOT many AND hops > 0
UNION ALL SELECT 'one_hot_' || m || '__' || path || '__' || col || '__' || val, 'one_hot_' || m, m, m, hops FROM p JOIN v USING (tab), (VALUES ('mean'), ('sum')) t(m) WHERE many
UNION ALL SELECT 'sequential_regression__' || path || '__' || col, 'sequential_regression', 'last', 'last', hops + 0.5 FROM p JOIN c USING (tab) WHERE many AND timed AND role = 'n'
UNION ALL SELECT CASE role WHEN 'c' THEN 'target' ELSE 'hist' END || '_encoding__' || path || '__' || col, CASE role WHEN 'c' THEN 'target' ELSE 'hist' END || '_encoding', 'mean', 'mean', hops + 0.5 FROM p JOIN c USING (tab))
SELECT name, kind, first, later, cost::DOUBLE AS cost FROM a"""
O = encodings.O
BOW_SQL = f"""WITH {BAGS} SELECT user_id, day, len(l) AS length, len(list_distinct(l)) AS nunique, len(l) - len(list_distinct(l)) AS duplicates,
(SELECT w FROM c WHERE c.user_id = b.user_id AND c.day = b.day ORDER BY n DESC, w LIMIT 1) AS mode, (SELECT max(n) FROM c WHERE c.user_id = b.user_id AND c.day = b.day) AS max_count, (SELECT min(n) FROM c WHERE c.user_id = b.user_id AND c.day = b.day) AS min_count FROM b"""
TE_SQL = "t AS (SELECT o_orderpriority AS c, sum(1 - is_train)::DOUBLE AS s, count(*) AS n FROM o GROUP BY 1), v AS (SELECT avg(1 - is_train) AS v FROM o)"
DRIFT_SQL = f"""WITH {O}, {TE_SQL},
f AS (SELECT 1 - is_train AS z, 'o_totalprice' AS feature, o_totalprice AS x FROM o UNION ALL SELECT 1 - is_train, 'bin', bin::DOUBLE FROM o UNION ALL SELECT 1 - is_train, 'o_orderpriority', (s + v) / (n + 1) FROM o JOIN t ON c = o_orderpriority, v),
r AS (SELECT feature, z, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM f),
g AS (SELECT feature, (sum(r) FILTER (z = 1) - sum(z) * (sum(z) + 1) / 2) / (sum(z) * sum(1 - z))::DOUBLE AS auc, stddev_pop(x) FILTER (z = 1) / nullif(stddev_pop(x) FILTER (z = 0), 0) AS sr,
      count(DISTINCT x) FILTER (z = 1) / count(DISTINCT x) FILTER (z = 0)::DOUBLE AS nr FROM r GROUP BY 1)
SELECT feature, round(auc, 6) + 0.0 AS auc, round(sr, 6) + 0.0 AS std_ratio, round(nr, 6) + 0.0 AS nunique_ratio, coalesce(abs(auc - 0.5) < 0.3, false) AND coalesce(sr BETWEEN 1 / 3.0 AND 3, false) AND coalesce(nr BETWEEN 1 / 3.0 AND 3, false) AS keep FROM g"""
GAIN_SQL = """WITH b AS (SELECT (l_returnflag = 'R')::INT AS z, l_quantity AS q, l_extendedprice AS e, l_discount AS d FROM lineitem),
f AS (SELECT z, unnest([{'f': 'q', 'x': q}, {'f': 'e', 'x': e}, {'f': 'd', 'x': d}, {'f': 'qe1', 'x': round(ln(1 + q) + ln(1 + e), 9)}, {'f': 'qe-1', 'x': round(ln(1 + q) - ln(1 + e), 9)}, {'f': 'qd1', 'x': round(ln(1 + q) + ln(1 + d), 9)},
      {'f': 'qd-1', 'x': round(ln(1 + q) - ln(1 + d), 9)}, {'f': 'ed1', 'x': round(ln(1 + e) + ln(1 + d), 9)}, {'f': 'ed-1', 'x': round(ln(1 + e) - ln(1 + d), 9)}]) AS u FROM b),
r AS (SELECT u.f AS f, z, rank() OVER (PARTITION BY u.f ORDER BY u.x) + (count(*) OVER (PARTITION BY u.f, u.x) - 1) / 2.0 AS r FROM f),
g AS (SELECT f, abs((sum(r) FILTER (z = 1) - sum(z) * (sum(z) + 1) / 2) / (sum(z) * sum(1 - z))::DOUBLE - 0.5) AS a FROM r GROUP BY 1)
SELECT n.a, n.b, n.s AS sign, round(p.a - greatest(x.a, y.a), 6) + 0.0 AS gain FROM (VALUES ('l_quantity', 'l_extendedprice', 1, 'qe1', 'q', 'e'), ('l_quantity', 'l_extendedprice', -1, 'qe-1', 'q', 'e'), ('l_quantity', 'l_discount', 1, 'qd1', 'q', 'd'),
('l_quantity', 'l_discount', -1, 'qd-1', 'q', 'd'), ('l_extendedprice', 'l_discount', 1, 'ed1', 'e', 'd'), ('l_extendedprice', 'l_discount', -1, 'ed-1', 'e', 'd')) n(a, b, s, f, i, j) JOIN g p ON p.f = n.f JOIN g x ON x.f = n.i JOIN g y ON y.f = n.j"""
TOP10_SQL = "WITH " + BAGS + ", t AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS i FROM c GROUP BY w) SELECT user_id, day, " + ", ".join(f"coalesce((SELECT n FROM c JOIN t USING (w) WHERE c.user_id = b.user_id AND c.day = b.day AND i = {i}), 0)::BIGINT AS count_{i}" for i in range(10)) + " FROM b"

BOW_PARTS = ["length", "nunique", "duplicates", "mode", "max_count", "min_count"]
QUERIES = {
    "time_parts_events": time_parts,
    "time_parts_gated": time_parts_gated,
    "freq_encode_part": freq_encode,
    "null_flags": null_flags,
    "constant_drop": constant_drop,
    "label_encode": label_encode,
    "most_common_part": most_common,
    "is_array": is_array,
    "trailing_count_events": trailing,
    "log_pair": log_pair,
    "rank_bucket": rank_bucket,
    "bow_features": bow,
    **{f"bow_{p}": bow_part(p) for p in BOW_PARTS},
    "bow_top10_counts": bow_top,
    "bow_stats": bow_stats,
    "bow_label_count": bow_labels,
    "bow_count_matrix": bow_matrix,
    "bow_tf_idf": tf_idf,
    "auc_rank": auc_rank,
    "drift_selector": drift,
    "factorized_log_pair": log_gain,
    "time_split": time_split,
    "column_stats": column_stats,
    "substance_detection": substance,
    "median_group_size": group_size,
    "self_mm_discovery": self_mm,
    "class_limits": class_limits,
    "union_train_test": union_train_test,
    "planned_candidates": planned,
    "batched_features": batched,
    "fit_predict": fit_predict,
    "model_search": searched,
    "stream_hourly": stream,
    "hashed_tf_idf": hashed,
    "heaviest_word": heaviest,
    "stream_asof_mean": asof_stream,
    "model_tuned": tuned,
    "propagated_targets": propagated,
    "propagated_surrogate": propagated_surrogates,
    "propagated_counts": propagated_counts,
}
SQL = {
    "time_parts_events": "SELECT event_id, hour(ts)::INT AS hour, year(ts)::INT AS year, dayofyear(ts)::INT AS dayofyear, (isodow(ts) - 1)::INT AS weekday, (isodow(ts) >= 6)::INT AS weekend, (hour(ts) // 6)::INT AS quarter_of_day, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) + 0.0 AS seconds FROM events",
    "time_parts_gated": "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, (isodow(ts) >= 6)::INT AS weekend, (hour(ts) // 6)::INT AS quarter_of_day FROM events",
    "freq_encode_part": "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS freq FROM part",
    "null_flags": "SELECT o_orderkey, (o_orderkey % 7 = 0)::INT AS price_is_null FROM orders",
    "constant_drop": "SELECT o_orderkey, o_totalprice, NULL::DOUBLE AS none FROM orders",
    "label_encode": "WITH f AS (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS label FROM part GROUP BY 1) SELECT p_partkey, label FROM part JOIN f USING (p_type)",
    "most_common_part": "SELECT p_brand, count(*) AS freq FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "is_array": "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS is_f FROM orders",
    "trailing_count_events": "WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY rn RANGE 49 PRECEDING) AS recent FROM r",
    "log_pair": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, round(ln(1 + l_quantity) + ln(1 + l_extendedprice), 6) + 0.0 AS plus, round(ln(1 + l_quantity) - ln(1 + l_extendedprice), 6) + 0.0 AS minus FROM lineitem",
    "rank_bucket": "SELECT p_partkey, CAST(floor((rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / greatest(1, (SELECT count(*) FROM part) // 100)) AS BIGINT) AS bucket FROM part",
    "bow_features": BOW_SQL,
    **{f"bow_{p}": f"SELECT user_id, day, {p} FROM ({BOW_SQL})" for p in BOW_PARTS},
    "bow_top10_counts": TOP10_SQL,
    "bow_stats": f"WITH {BAGS} SELECT sum(len(l))::BIGINT AS total_words, max(len(l))::BIGINT AS max_words, round(avg(len(l)), 6) + 0.0 AS mean_words, (SELECT count(DISTINCT w) FROM c) AS unique_words FROM b",
    "bow_label_count": f"WITH {BAGS} SELECT w AS word, sum(n * (user_id % 2))::BIGINT AS labels, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "bow_count_matrix": f"WITH {BAGS} SELECT user_id::VARCHAR || '_' || strftime(day, '%Y-%m-%d') AS row, w AS word, n FROM c",
    "bow_tf_idf": "WITH c AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM c GROUP BY 1) SELECT p_partkey, w AS word, round(n * ln((SELECT count(*) FROM part) / df::DOUBLE), 6) + 0.0 AS weight FROM c JOIN d USING (w)",
    "auc_rank": f"""WITH {O}, f AS (SELECT y, unnest([{{'f': 'o_totalprice', 'x': o_totalprice}}, {{'f': 'grp', 'x': grp::DOUBLE}}, {{'f': 'bin', 'x': bin::DOUBLE}}]) AS u FROM o WHERE y IS NOT NULL),
r AS (SELECT u.f AS f, y, rank() OVER (PARTITION BY u.f ORDER BY u.x) + (count(*) OVER (PARTITION BY u.f, u.x) - 1) / 2.0 AS r FROM f)
SELECT f AS feature, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) + 0.0 AS auc FROM r GROUP BY 1""",
    "drift_selector": DRIFT_SQL,
    "factorized_log_pair": GAIN_SQL,
    "time_split": f"WITH {EVENTS_SQL}, q AS (SELECT quantile_cont(sec, 0.8) AS c FROM e) SELECT event_id, (sec > c)::INT AS is_valid FROM e, q",
    "column_stats": " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS nunique FROM lineitem" for c in ("l_partkey", "l_returnflag", "l_quantity", "l_linenumber")),
    "substance_detection": "WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), k AS (SELECT o_custkey, count(DISTINCT o_custkey % 2) AS h, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_totalprice) AS p FROM orders JOIN t USING (o_custkey) GROUP BY 1) SELECT 'half' AS feature, max(h) <= 1 AS constant FROM k UNION ALL SELECT 'o_orderstatus', max(s) <= 1 FROM k UNION ALL SELECT 'o_totalprice', max(p) <= 1 FROM k",
    "median_group_size": "SELECT median(n)::DOUBLE AS median_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "self_mm_discovery": " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) > sqrt(count(*)) AND count(DISTINCT {c}) < count(*) / 2.0 AS related FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderkey")),
    "class_limits": f"WITH {O}, c AS (SELECT least(count(*) FILTER (y > 0), count(*) FILTER (y <= 0)) AS k FROM o) SELECT k AS minority, round(sqrt(k), 6) + 0.0 AS max_categories FROM c",
    "union_train_test": "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderstatus = 'F')::INT END AS y, (o_orderkey % 5 = 0)::INT AS is_test FROM orders",
    "planned_candidates": PLAN_SQL,
    "batched_features": """WITH l AS (SELECT l_orderkey, avg(l_quantity) AS a, max(l_quantity) AS b, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1),
s AS (SELECT s.o_orderkey, count(*) AS n, list(d.o_totalprice ORDER BY d.o_orderdate, d.o_orderkey) AS p FROM orders s JOIN orders d ON d.o_custkey = s.o_custkey AND d.o_orderdate <= s.o_orderdate GROUP BY 1)
SELECT o_orderkey, round(c_acctbal, 6) + 0.0 AS acctbal, c_mktsegment AS segment, round(a, 6) + 0.0 AS mean_quantity, round(b, 6) + 0.0 AS max_quantity, coalesce(c, 0)::DOUBLE AS flags, n::DOUBLE AS orders_so_far, round(list_sum(p[-10:]), 6) + 0.0 AS last_ten
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey JOIN s USING (o_orderkey)""",
    "stream_hourly": "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean, arg_max(value, ts) AS last FROM events GROUP BY 1, 2",
    "hashed_tf_idf": "WITH c AS (SELECT p_partkey, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2), d AS (SELECT bucket, count(*) AS df FROM c GROUP BY 1) SELECT p_partkey, bucket, round(n * ln((SELECT count(*) FROM part) / df::DOUBLE), 6) + 0.0 AS weight FROM c JOIN d USING (bucket)",
    "heaviest_word": "WITH c AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM c GROUP BY 1), x AS (SELECT p_partkey, w, round(n * ln((SELECT count(*) FROM part) / df::DOUBLE), 9) AS x FROM c JOIN d USING (w)) SELECT p_partkey, w AS word, round(x, 6) + 0.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY x DESC, w) AS r FROM x) WHERE r = 1",
    "stream_asof_mean": f"WITH e AS (SELECT * FROM events) SELECT a.event_id, round(avg(b.value) + {TIE}, 6) + 0.0 AS feature FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1",
    "propagated_targets": PROPAGATED_SQL,
    "propagated_surrogate": SURROGATES_SQL,
    "propagated_counts": COUNTED_SQL,
}
