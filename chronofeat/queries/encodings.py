"""Queries on target encodings and propagation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.functions import matrix
from chronofeat.functions.scalar import rank_bucket
from chronofeat.operators import propagate
from chronofeat.operators import target_encoding as te


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a classification table: the target is whether an order is finished, unknown for a fifth."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderstatus") == "F").cast("double"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", y.alias("y"), F.floor(day / 30).alias("bin"), (F.col("o_orderkey") % 5 != 0).cast("int").alias("is_train"), (F.col("o_custkey") % 40).alias("grp"))


O = """o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderstatus = 'F')::INT::DOUBLE END AS y,
     floor(datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 30.0)::BIGINT AS bin, (o_orderkey % 5 <> 0)::INT AS is_train, o_custkey % 40 AS grp FROM orders),
m AS (SELECT avg(y) AS m FROM o)"""


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag of words per order: brand, type words and size class of its parts."""
    o = orders(spark, sf_dir).select("o_orderkey", "y", "bin")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    b = i.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list("w").alias("words"))
    return o.join(b, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "y", "bin", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


B = f"""{O}, w AS (SELECT o_orderkey, y, bin, w, count(*)::DOUBLE AS c FROM (SELECT o_orderkey, y, bin, unnest(string_split(p_name, ' ')) AS w FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2, 3, 4)"""


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and the words of bags() as (o_orderkey, words), a row an item."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("words"))
    return orders(spark, sf_dir).select("o_orderkey", "y", "bin", "is_train"), i.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "words")


def marked_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """parts() with, in each bag, a word that only training rows or only others hold."""
    o, words = parts(spark, sf_dir)
    return o, words.unionByName(o.select("o_orderkey", F.array(F.concat(F.lit("side"), (F.col("o_orderkey") % 5).cast("string"))).alias("words")))


def customer_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the bag of their customer: its segment twice and its nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = c.select("c_custkey", F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_mktsegment").alias("words"))
    return te.bag_through(orders(spark, sf_dir).select("o_orderkey", "o_custkey", "y", "bin"), c, ("o_custkey", "c_custkey"), "words")


MARKED = """SELECT o_orderkey, y, bin, is_train, w, count(*)::DOUBLE AS c FROM (SELECT o_orderkey, y, bin, is_train, unnest(string_split(p_name, ' ')) AS w FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
UNION ALL SELECT o_orderkey, y, bin, is_train, 'side' || (o_orderkey % 5) FROM o) GROUP BY 1, 2, 3, 4, 5"""
CUSTOMERS = "SELECT o_orderkey, y, bin, is_train, w, count(*)::DOUBLE AS c FROM (SELECT o_orderkey, y, bin, is_train, unnest([c_mktsegment, 'n' || c_nationkey, c_mktsegment]) AS w FROM o JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2, 3, 4, 5"


def encoded(f, *args, **kw):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(orders(spark, sf_dir), *args, name="feature", **kw).select("o_orderkey", (F.round("feature", 6) + 0.0).alias("feature"))

    return q


def encoded_bag(time: str | None, made=parts, is_train: str | None = None):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = made(spark, sf_dir)
        rows, words = got if isinstance(got, tuple) else (got, "words")
        return te.bag(rows, "o_orderkey", words, "y", 5.0, 20.0, "feature", time, is_train).select("o_orderkey", (F.round("feature", 6) + 0.0).alias("feature"))

    return q


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rank_bucket(orders(spark, sf_dir), "o_totalprice", "bucket")
    return te.temporal(o, "bucket", "y", "bin", 100.0, "feature").select("o_orderkey", "bucket", (F.round("feature", 6) + 0.0).alias("feature"))


def induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = te.through(orders(spark, sf_dir), c, ("o_custkey", "c_custkey"), "c_mktsegment")
    return te.leave_one_out(o, "c_mktsegment", "y", 5.0, "feature").select("o_orderkey", (F.round("feature", 6) + 0.0).alias("feature"))


def te_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding at the orders of a customer, brought to the customer by its mean."""
    from chronofeat.operators.temporal import aggregate

    o = te.leave_one_out(orders(spark, sf_dir), "o_orderpriority", "y", 5.0, "e")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return aggregate(c, o, ("c_custkey", "o_custkey"), [("feature", "e", "mean")]).select("c_custkey", (F.round("feature", 6) + 0.0).alias("feature"))


def loo_sql(c: str, k: float) -> str:
    return f"""WITH {O}, t AS (SELECT {c} AS c, coalesce(sum(y), 0) AS s, count(y) AS n FROM o GROUP BY 1)
SELECT o_orderkey, round((s - coalesce(y, 0) + m * {k}) / (n - (y IS NOT NULL)::INT + {k}), 6) + 0.0 AS feature FROM o JOIN t ON t.c = o.{c}, m"""


def temporal_sql(c: str, k: float) -> str:
    return f"""WITH {O} SELECT a.o_orderkey, round(CASE WHEN count(b.y) = 0 THEN any_value(m) ELSE (sum(b.y) + any_value(m) * {k}) / (count(b.y) + {k}) END, 6) + 0.0 AS feature
FROM o a CROSS JOIN m LEFT JOIN o b ON b.{c} = a.{c} AND b.bin < a.bin GROUP BY a.o_orderkey"""


def expmov_sql(c: str, beta: float, k: float) -> str:
    return f"""WITH {O}, b AS (SELECT {c} AS c, bin, coalesce(sum(y), 0) AS s, count(y)::DOUBLE AS n FROM o GROUP BY 1, 2),
p AS (SELECT x.c, x.bin, coalesce(sum(z.s * exp(-{beta} * (x.bin - z.bin))), 0) AS s, coalesce(sum(z.n * exp(-{beta} * (x.bin - z.bin))), 0) AS n FROM b x LEFT JOIN b z ON z.c = x.c AND z.bin < x.bin GROUP BY 1, 2)
SELECT o_orderkey, round(CASE WHEN n = 0 THEN m ELSE (s + m * {k}) / (n + {k}) END, 6) + 0.0 AS feature FROM o JOIN p ON p.c = o.{c} AND p.bin = o.bin, m"""


def factorized_sql(temporal: bool) -> str:
    k0, k1, k2 = 25.0, 5.0, 5.0
    on = "b.bin < a.bin" if temporal else "b.o_orderkey <> a.o_orderkey"
    sub = lambda n, cond: f"t{n} AS (SELECT a.o_orderkey, coalesce(sum(b.y), 0) AS s, count(b.y) AS n FROM o a LEFT JOIN o b ON {cond} AND {on} GROUP BY 1)"
    if temporal:
        parts = ", ".join([sub(1, "b.o_orderpriority = a.o_orderpriority"), sub(2, "b.grp = a.grp"), sub(3, "b.o_orderpriority = a.o_orderpriority AND b.grp = a.grp")])
    else:
        g = lambda n, by: f"t{n} AS (SELECT o_orderkey, sum(y) OVER ({by}) - coalesce(y, 0) AS s, count(y) OVER ({by}) - (y IS NOT NULL)::INT AS n FROM o)"
        parts = ", ".join([g(1, "PARTITION BY o_orderpriority"), g(2, "PARTITION BY grp"), g(3, "PARTITION BY o_orderpriority, grp")])
    return f"""WITH {O}, {parts}
SELECT o_orderkey, round(({k1} * (t1.s / nullif(t1.n, 0)) + {k2} * (t2.s / nullif(t2.n, 0)) + t3.s + m * {k0}) / (t3.n + {k1 + k2 + k0}), 6) + 0.0 AS feature
FROM t1 JOIN t2 USING (o_orderkey) JOIN t3 USING (o_orderkey), m"""


def regularized_sql() -> str:
    return f"""WITH {O}, v AS (SELECT grp FROM o GROUP BY 1 HAVING avg(is_train) BETWEEN 0.01 AND 0.99),
t AS (SELECT o.grp, coalesce(sum(CASE WHEN v.grp IS NOT NULL THEN y END), 0) AS s, count(CASE WHEN v.grp IS NOT NULL THEN y END) AS n FROM o LEFT JOIN v ON v.grp = o.grp GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN n = 0 THEN m ELSE (s - CASE WHEN v.grp IS NOT NULL THEN coalesce(y, 0) ELSE 0 END + m * 40) / (n - (v.grp IS NOT NULL AND y IS NOT NULL)::INT + 40) END, 6) + 0.0 AS feature
FROM o JOIN t ON t.grp = o.grp LEFT JOIN v ON v.grp = o.grp, m"""


def bag_sql(temporal: bool) -> str:
    if temporal:
        mid = """tw AS (SELECT a.o_orderkey, a.w, a.c, a.bin, coalesce(sum(b.c * b.y), 0) AS t, coalesce(sum(b.c) FILTER (b.y IS NOT NULL), 0) AS n FROM w a LEFT JOIN w b ON b.w = a.w AND b.bin < a.bin GROUP BY 1, 2, 3, 4),
g AS (SELECT bin, sum(c * y) AS t, sum(c) FILTER (y IS NOT NULL) AS n FROM w GROUP BY 1), h AS (SELECT x.bin, sum(z.t) / nullif(sum(z.n), 0) AS mw FROM g x LEFT JOIN g z ON z.bin < x.bin GROUP BY 1),
r AS (SELECT o_orderkey, sum(c * (t + 5 * mw)) AS num, sum(c * (n + 5)) AS den, bool_or(mw IS NULL) AS none FROM tw JOIN h USING (bin) GROUP BY 1)"""
    else:
        mid = """tw AS (SELECT w, coalesce(sum(c * y), 0) AS t, coalesce(sum(c) FILTER (y IS NOT NULL), 0) AS n FROM w GROUP BY 1), h AS (SELECT sum(t) / nullif(sum(n), 0) AS mw FROM tw),
r AS (SELECT o_orderkey, sum(c * (t - coalesce(y * c, 0) + 5 * mw)) AS num, sum(c * (n - CASE WHEN y IS NULL THEN 0 ELSE c END + 5)) AS den, bool_or(mw IS NULL) AS none FROM w JOIN tw USING (w), h GROUP BY 1)"""
    return f"WITH {B}, {mid} SELECT o_orderkey, round(CASE WHEN den IS NULL THEN m WHEN NOT none THEN (num + m * 20) / (den + 20) END, 6) + 0.0 AS feature FROM o LEFT JOIN r USING (o_orderkey), m"


def words_sql(words: str, temporal: bool, gated: bool) -> str:
    """bag_sql() over other words, with sums by windows, and with one-sided words left out if gated."""
    upto = "ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    if temporal:
        mid = f"""b AS (SELECT w, bin, coalesce(sum(yc), 0) AS t, coalesce(sum(kc), 0) AS n FROM k GROUP BY 1, 2),
tw AS (SELECT w, bin, coalesce(sum(t) OVER (PARTITION BY w {upto}), 0) AS t, coalesce(sum(n) OVER (PARTITION BY w {upto}), 0) AS n FROM b),
g AS (SELECT bin, sum(t) AS t, sum(n) AS n FROM b GROUP BY 1), h AS (SELECT bin, sum(t) OVER ({upto}) / nullif(sum(n) OVER ({upto}), 0) AS mw FROM g),
r AS (SELECT o_orderkey, sum(c * (t + 5 * mw)) AS num, sum(c * (n + 5)) AS den, bool_or(mw IS NULL) AS none FROM k JOIN tw USING (w, bin) JOIN h USING (bin) GROUP BY 1)"""
    else:
        mid = """tw AS (SELECT w, coalesce(sum(yc), 0) AS t, coalesce(sum(kc), 0) AS n FROM k GROUP BY 1), h AS (SELECT sum(t) / nullif(sum(n), 0) AS mw FROM tw),
r AS (SELECT o_orderkey, sum(c * (t - coalesce(yc, 0) + 5 * mw)) AS num, sum(c * (n - coalesce(kc, 0) + 5)) AS den, bool_or(mw IS NULL) AS none FROM k JOIN tw USING (w), h GROUP BY 1)"""
    ok = "sum(c * is_train) / sum(c) BETWEEN 0.01 AND 0.99" if gated else "TRUE"
    return f"""WITH {O}, w AS ({words}), v AS (SELECT w, {ok} AS ok FROM w GROUP BY 1),
k AS (SELECT o_orderkey, w, bin, c, CASE WHEN ok THEN c * y END AS yc, CASE WHEN ok AND y IS NOT NULL THEN c END AS kc FROM w JOIN v USING (w)), {mid}
SELECT o_orderkey, round(CASE WHEN den IS NULL THEN m WHEN NOT none THEN (num + m * 20) / (den + 20) END, 6) + 0.0 AS feature FROM o LEFT JOIN r USING (o_orderkey), m"""


HIST_SQL = f"""WITH {O}, k AS (SELECT o_orderkey, CAST(floor((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / greatest(1, (SELECT count(*) FROM o) // 100)) AS BIGINT) AS bucket FROM o),
z AS (SELECT o.*, bucket FROM o JOIN k USING (o_orderkey))
SELECT a.o_orderkey, a.bucket, round(CASE WHEN count(b.y) = 0 THEN any_value(m) ELSE (sum(b.y) + any_value(m) * 100) / (count(b.y) + 100) END, 6) + 0.0 AS feature
FROM z a CROSS JOIN m LEFT JOIN z b ON b.bucket = a.bucket AND b.bin < a.bin GROUP BY 1, 2"""


def pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return propagate.pseudo_target(orders(spark, sf_dir), c, ("o_custkey", "c_custkey"), "y", "pseudo").select("c_custkey", F.round("pseudo", 6).alias("pseudo"))


def surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    t = propagate.pseudo_target(orders(spark, sf_dir), c, ("o_custkey", "c_custkey"), "y", "pseudo")
    return propagate.surrogate(t, ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "pseudo").select("feature", F.round("auc", 6).alias("auc"), F.round("distance", 6).alias("distance"))


def surrogate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo target of customers, replaced by the column that tells it best."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    t = propagate.pseudo_target(orders(spark, sf_dir), c, ("o_custkey", "c_custkey"), "y", "pseudo")
    return propagate.with_surrogate(t, ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "pseudo", "target").select("c_custkey", "target")


def svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the three leading singular vectors of their priority, group and words."""
    b = bags(spark, sf_dir).select("o_orderkey", "words")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "grp").join(b, "o_orderkey")
    return matrix.truncated_svd(rows, "o_orderkey", ["o_orderpriority", "grp"], ["words"], 3)[0]


def svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of orders' priorities and states, put together again from all its singular vectors: its ones and its zeros."""
    made = matrix.entries(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", ["o_orderpriority", "o_orderstatus"], [])
    left, right, values = matrix.decomposed(made, 8)
    cell = sum((F.col(f"u_{i}") * F.col(f"v_{i}") * x for i, x in enumerate(values)), F.lit(0.0))
    # Eight features at most: a row is met with each.
    return left.crossJoin(F.broadcast(right)).select(F.col("row").alias("o_orderkey"), F.col("feature.value").alias("value"), (F.round(cell, 4) + 0.0).alias("cell"))


def ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix itself, as its ones."""
    b = bags(spark, sf_dir).select("o_orderkey", "words")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "grp").join(b, "o_orderkey")
    return matrix.entries(rows, "o_orderkey", ["o_orderpriority", "grp"], ["words"]).select(F.col("row").alias("o_orderkey"), "feature.column", "feature.value")


ONES_SQL = f"""WITH {O} SELECT o_orderkey, 'o_orderpriority' AS column, o_orderpriority AS value FROM o WHERE o_orderpriority IS NOT NULL UNION ALL SELECT o_orderkey, 'grp', grp::VARCHAR FROM o WHERE grp IS NOT NULL
UNION ALL SELECT DISTINCT o_orderkey, 'words', unnest(string_split(p_name, ' ')) FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return propagate.train_counts(orders(spark, sf_dir), c, ("o_custkey", "c_custkey"), "is_train")


PSEUDO_SQL = f"""WITH {O}, t AS (SELECT o_custkey, sum(y) AS s, count(y) AS n FROM o GROUP BY 1)
SELECT c_custkey, round((coalesce(s, 0) + 1000 * m) / (coalesce(n, 0) + 1000), 6) AS pseudo FROM customer LEFT JOIN t ON o_custkey = c_custkey, m"""
SURROGATE_SQL = f"""WITH {O}, t AS (SELECT o_custkey, sum(y) AS s, count(y) AS n FROM o GROUP BY 1),
c AS (SELECT customer.*, (coalesce(s, 0) + 1000 * m) / (coalesce(n, 0) + 1000) AS p FROM customer LEFT JOIN t ON o_custkey = c_custkey, m),
g AS (SELECT avg(p) AS a, median(c_acctbal) AS b, median(c_nationkey) AS d, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS e FROM c),
f AS (SELECT (p > a) AS y, 'c_acctbal' AS feature, (c_acctbal > b)::INT AS x FROM c, g UNION ALL SELECT p > a, 'c_nationkey', (c_nationkey > d)::INT FROM c, g UNION ALL SELECT p > a, 'c_mktsegment', (c_mktsegment = e)::INT FROM c, g),
r AS (SELECT feature, y, x, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2, 3),
u AS (SELECT p.feature, sum(p.n * q.n * CASE WHEN p.x > q.x THEN 1 WHEN p.x = q.x THEN 0.5 ELSE 0 END) / sum(p.n * q.n) AS auc FROM r p JOIN r q ON p.feature = q.feature AND p.y AND NOT q.y GROUP BY 1)
SELECT feature, round(auc, 6) AS auc, round(abs(auc - 0.5), 6) AS distance FROM u"""
CHOSEN_SQL = SURROGATE_SQL.rsplit("SELECT", 1)[0].rstrip() + """, best AS (SELECT feature FROM u WHERE auc <> 0.5 ORDER BY round(abs(auc - 0.5), 9) DESC, feature LIMIT 1)
SELECT c_custkey, CASE feature WHEN 'c_acctbal' THEN (c_acctbal > b)::INT WHEN 'c_nationkey' THEN (c_nationkey > d)::INT WHEN 'c_mktsegment' THEN (c_mktsegment = e)::INT ELSE p END::DOUBLE AS target FROM c CROSS JOIN g LEFT JOIN best ON TRUE"""

QUERIES = {
    "te_loo": encoded(te.leave_one_out, "o_orderpriority", "y", 5.0),
    "te_not_loo": encoded(te.whole, "o_orderpriority", "y", 5.0),
    "te_temporal": encoded(te.temporal, "grp", "y", "bin", 40.0),
    "te_expmov": encoded(te.exponential, "grp", "y", "bin", 0.1, 40.0),
    "te_factorized": encoded(te.factorized, "o_orderpriority", "grp", "y", (25, 5, 5)),
    "te_factorized_temporal": encoded(te.factorized, "o_orderpriority", "grp", "y", (25, 5, 5), time="bin"),
    "te_adversarial": encoded(te.regularized, "grp", "y", "is_train", 40.0),
    "te_bow": encoded_bag(None),
    "te_bow_temporal": encoded_bag("bin"),
    "te_bow_induced": encoded_bag(None, customer_bags),
    "te_bow_induced_temporal": encoded_bag("bin", customer_bags),
    "te_bow_adversarial": encoded_bag(None, marked_bags, "is_train"),
    "te_bow_adversarial_temporal": encoded_bag("bin", marked_bags, "is_train"),
    "te_adversarial_temporal": encoded(te.regularized, "grp", "y", "is_train", 40.0, time="bin"),
    "te_hist": hist,
    "te_induced": induced,
    "te_path_mean": te_path,
    "pseudo_target_customer": pseudo,
    "surrogate_target": surrogate,
    "surrogate_column": surrogate_column,
    "factorized_matrix": ones,
    "factorized_svd": svd,
    "factorized_products": svd_values,
    "adversarial_counts": counts,
}
SQL = {
    "te_loo": loo_sql("o_orderpriority", 5.0),
    "te_not_loo": f"WITH {O}, t AS (SELECT o_orderpriority AS c, sum(y) AS s, count(y) AS n FROM o GROUP BY 1) SELECT o_orderkey, round((s + m * 5) / (n + 5), 6) + 0.0 AS feature FROM o JOIN t ON c = o_orderpriority, m",
    "te_temporal": temporal_sql("grp", 40.0),
    "te_expmov": expmov_sql("grp", 0.1, 40.0),
    "te_factorized": factorized_sql(False),
    "te_factorized_temporal": factorized_sql(True),
    "te_adversarial": regularized_sql(),
    "te_bow": bag_sql(False),
    "te_bow_temporal": bag_sql(True),
    "te_bow_induced": words_sql(CUSTOMERS, False, False),
    "te_bow_induced_temporal": words_sql(CUSTOMERS, True, False),
    "te_bow_adversarial": words_sql(MARKED, False, True),
    "te_bow_adversarial_temporal": words_sql(MARKED, True, True),
    "te_adversarial_temporal": temporal_sql("grp", 40.0),
    "te_hist": HIST_SQL,
    "te_induced": f"WITH {O}, a AS (SELECT o.*, c_mktsegment FROM o JOIN customer ON c_custkey = o_custkey), t AS (SELECT c_mktsegment AS c, sum(y) AS s, count(y) AS n FROM a GROUP BY 1) SELECT o_orderkey, round((s - coalesce(y, 0) + m * 5) / (n - (y IS NOT NULL)::INT + 5), 6) + 0.0 AS feature FROM a JOIN t ON t.c = c_mktsegment, m",
    "te_path_mean": f"WITH {O}, t AS (SELECT o_orderpriority AS c, sum(y) AS s, count(y) AS n FROM o GROUP BY 1), e AS (SELECT o_custkey, (s - coalesce(y, 0) + m * 5) / (n - (y IS NOT NULL)::INT + 5) AS e FROM o JOIN t ON c = o_orderpriority, m) SELECT c_custkey, round(avg(e), 6) + 0.0 AS feature FROM customer LEFT JOIN e ON o_custkey = c_custkey GROUP BY 1",
    "pseudo_target_customer": PSEUDO_SQL,
    "surrogate_target": SURROGATE_SQL,
    "surrogate_column": CHOSEN_SQL,
    "factorized_matrix": ONES_SQL,
    "factorized_products": "WITH f AS (SELECT DISTINCT 'p' AS c, o_orderpriority AS value FROM orders UNION ALL SELECT DISTINCT 's', o_orderstatus FROM orders) SELECT o_orderkey, value, (value = CASE c WHEN 'p' THEN o_orderpriority ELSE o_orderstatus END)::INT::DOUBLE AS cell FROM orders, f",
    "adversarial_counts": f"WITH {O} SELECT c_custkey, coalesce(sum(is_train), 0)::BIGINT AS n_train, count(o_orderkey) AS n_all FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1",
}
