"""Source divergence: how far the word use of the sources of a language lies apart.

Terms are counted by (language, source) in tasks that fold many documents, and met once by a shuffle on (language,
term). A language keeps the terms that enough of its documents hold. Each kept term has a smoothed share p in each
source, and the distance of two sources is the sum of |p - q| over all kept terms.

Joint count histograms: blocks of kept terms become matrices of terms by sources, from which each pair of sources tallies
how many terms have counts (a, b) in both, so terms are never paired up one by one. Terms that one of them
lacks are implied: those with count a less those tallied with it give the cell (a, 0), and what is left of the vocabulary
gives (0, 0). |p - q| is then taken once per cell, times its terms.

A hot source is spread over all tasks; what meets is a row per task, source and term. Numbers are integers
and decimals throughout. A language's sources are paired, as the report demands: its size is the square of their number.

Defined cases: null texts, languages and sources are empty strings; repeated rows and ids count each; a group without terms,
and a language that keeps none, has its pairs with the value that follows, or 0; ties are ranked by name in UTF-8; very long texts
are counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read, small

#: Documents of its language that must hold a term; share of one; what each count is raised by; ranks of the report of terms.
LEAST_DOCS, UNIT, PRIOR, BEST = 30, 1_000_000_000, 5, 50
#: Distinct terms that a task folds before it hands them on.
HELD = 400_000
#: Letters of ASCII in lower case and all bytes beyond ASCII; any other byte parts terms.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of (lang, source, text), partly folded."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            parts = []
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                parts.append((pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in terms], pa.int64())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["lang", "source", "term", "n", "n_docs"])

        for batch in given:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                terms = text.as_py().translate(TERM).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield out()
        if held:
            yield out()

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, parts): kept terms with (source, n) of each source that has them. One shuffle, by language and term, serves both sums."""
    dealt = counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("parts"))
    return terms.filter(F.col("n_docs") >= least).drop("n_docs")


def tallies(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (x, y), and how often each occurs."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    return x[first], y[first], np.diff(np.append(first, len(x)))


def joint(kept: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): how many terms have counts ca > 0 in source a and cb > 0 in source b, for a < b; partly summed."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            lists = batch.column(1)
            per = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            source, n = np.array(flat.field(0).to_pylist(), dtype=object), flat.field(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(langs)), per)
            for lang in set(langs.tolist()):
                here = np.flatnonzero(langs[row] == lang)
                if not len(here):
                    continue
                names = sorted(set(source[here].tolist()), key=lambda s: s.encode())
                number = {s: i for i, s in enumerate(names)}
                rows, r = np.unique(row[here], return_inverse=True)
                m = np.zeros((len(names), len(rows)), dtype=np.int64)
                m[[number[s] for s in source[here].tolist()], r] = n[here]
                for i in range(len(names)):
                    mine = np.flatnonzero(m[i])
                    x = m[i, mine]
                    for j in range(i + 1, len(names)):
                        y = m[j, mine]
                        both = y > 0
                        if both.any():
                            ca, cb, tally = tallies(x[both], y[both])
                            yield pa.RecordBatch.from_arrays([*[pa.repeat(v, len(ca)) for v in (lang, names[i], names[j])], pa.array(ca), pa.array(cb), pa.array(tally)], ["lang", "a", "b", "ca", "cb", "m"])

    return kept.select("lang", "parts").mapInArrow(run, "lang string, a string, b string, ca long, cb long, m long")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), in decimals."""
    return F.expr(f"1L + (cast({UNIT} as decimal(10)) * cast({n} + {PRIOR} as decimal(19))) div cast({total} + {PRIOR} * {terms} as decimal(19))")


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= most) if most else out


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two reports (lang, source, item, value, rank): distances to the other sources of the language, and the terms that a source uses most above its language."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), named(text_col).cast("binary").alias("text"))
    kept = cut(vocabulary(docs, least_docs), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("of_lang"))
    parts = kept.select("lang", "term", "total", F.inline("parts"))
    held = parts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("words"))
    groups = docs.select("lang", "source").distinct().join(small(cut(langs, "langs")), "lang", "left").join(held, ["lang", "source"], "left").fillna(0, ["v", "of_lang", "terms", "words"])
    groups = cut(groups, "groups")
    named_as = lambda x, n: groups.select("lang", *[F.col(c).alias(f"{n}_{c}") for c in ("source", "terms", "words")], *([F.col("v")] if n == "a" else []))
    pairs = cut(named_as(groups, "a").join(named_as(groups, "b"), "lang").filter("a_source < b_source"), "pairs")

    tallied = cut(joint(kept).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")), "tallied")
    # Cells with a count of zero are implied: what the tallies of a count leave of the terms that have it.
    zero = F.lit(0).cast("long")
    margin = parts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    lone_a = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b")).join(margin.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("ca"), zero.alias("cb"), "m")
    lone_b = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b")).join(margin.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), F.col("n").alias("cb"), "m")
    neither = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("a_terms") - F.col("b_terms")).alias("m"))
    signed = tallied.select("lang", "a", "b", F.inline(F.array(*[F.struct((F.col("ca") if p else zero).alias("ca"), (F.col("cb") if q else zero).alias("cb"), (F.col("m") if p == q else -F.col("m")).alias("m")) for p in (True, False) for q in (True, False)])))
    cells = signed.unionByName(lone_a).unionByName(lone_b).unionByName(neither).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).filter("m <> 0")

    sized = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), "a_words", "b_words", "v")
    f = F.abs(share("ca", "a_words", "v") - share("cb", "b_words", "v"))
    value = cells.join(small(sized), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    # Languages that keep no term have no cells.
    value = sized.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    both = value.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")

    above = parts.join(small(groups.select("lang", "source", "v", "of_lang", "words")), ["lang", "source"])
    above = above.withColumn("value", share("n", "words", "v") - share("total", "of_lang", "v")).filter("value > 0")
    return ranked(both), ranked(above.select("lang", "source", F.col("term").alias("item"), "value"), best)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair, term = divergence(read(spark, sf_dir, "documents"))
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").unionByName(columns(term, "term"))


SQL = {
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * l.v) AS p,
             1 + CAST(1000000000 AS HUGEINT) * (k.total + 5) // (l.n + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM b UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM z WHERE part = 'pair' OR k <= 50"""
}
