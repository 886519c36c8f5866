"""Secret scans by character Markov models.

Base kinds are patterns. The method adds tokens of secret-like characters whose characters follow a
Markov model of random strings rather than one of ordinary identifiers: the sum over the token's character pairs
of the log-likelihood ratio, in total and per character, must pass a threshold, and the token may overlap no base span.
Both models are counts of character pairs over labelled samples: SAMPLE_STRINGS random strings of hex, base64 and
upper-case kinds each, made from digests of a range; and the words of all documents, alone and joined as
identifiers. Words are counted map side, and character pairs over distinct words. The model is a
table of (pair, ratio), at most the alphabet squared, and is broadcast.

Places of matches are sums of lengths of the pieces between them, in code points.

Defined cases: a null text is empty; without spans the digest is that of the empty string; rows that repeat get the
same result each; a null id is a value like any other; very long texts are read whole; without words all ordinary pairs are alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read, small

KINDS = ["assign", "access", "hex", "markov"]
#: kind: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge; thresholds in nats, in total and per pair.
CANDIDATE, LEAST_TOTAL, LEAST_MEAN = r"[A-Za-z0-9+/_=-]{20,}", 15.0, 0.75
SPANS = "array<struct<start:bigint,k:int,end:bigint>>"
SAMPLE_STRINGS, SMOOTH = 3000, 0.5
MERGED = "array<struct<start:bigint,end:bigint>>"
#: Characters of a token that are taken apart at a time, and of a text that is redacted.
PIECE, PAGE = 256, 4096


def places(rows: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """(doc_id, _th, kind, start, end, token) of the pattern's matches over rows of doc_id, _th, text."""
    hits = rows.filter(F.col("text").rlike(pattern)).withColumn("_row", F.monotonically_increasing_id())
    p = F.lit(pattern)
    match = F.regexp_extract_all("text", p, F.lit(0))
    counted = F.regexp_extract_all("text", p, F.lit(group)) if group else match
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("before"), match.alias("match"), counted.alias("counted"))
    flat = hits.select("doc_id", "_th", "_row", F.posexplode(parts).alias("i", "p")).select("doc_id", "_th", "_row", "i", F.char_length("p.before").alias("gap"), F.col("p.match").alias("token"), F.char_length("p.counted").alias("size"))
    w = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.coalesce(F.char_length("token"), F.lit(0))
    placed = flat.withColumn("end", F.sum(F.col("gap") + length).over(w).cast("long")).withColumn("start", F.col("end") - length)
    return placed.filter(F.col("token").isNotNull() & (F.col("size") >= least)).select("doc_id", "_th", F.lit(kind).alias("kind"), "start", "end", "token").distinct()


def pieces(token: Column) -> Column:
    """A token in pieces of PIECE characters, each with the first character of the next, so that their pairs are the token's: the time is in proportion to its length."""
    cut_up = F.regexp_extract_all(token, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.zip_with(cut_up, F.slice(cut_up, F.lit(2), F.greatest(F.size(cut_up), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, 1), F.lit(""))))
    return F.filter(whole, lambda p: F.char_length(p) > 1)


def with_pairs(rows: DataFrame, token: str, keep: list[str]) -> DataFrame:
    """A row with `pair` for each pair of neighbouring characters of the token; a row holds a piece's pairs at most before they are spread."""
    by_piece = rows.select(*keep, F.explode(pieces(F.col(token))).alias("_piece"))
    pair = F.transform(F.sequence(F.lit(1), F.char_length("_piece") - 1), lambda i: F.substring(F.col("_piece"), i, F.lit(2)))
    return by_piece.select(*keep, F.explode(pair).alias("pair"))


def random_pairs(spark: SparkSession) -> DataFrame:
    """(pair, n1): character pairs of random strings of hex, base64 and upper-case kinds."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    random = spark.range(SAMPLE_STRINGS).select(F.explode(F.array(F.substring(digest, 1, 40), base64, F.regexp_replace(F.upper(base64), "[+/=]", ""))).alias("token"))
    return with_pairs(random, "token", []).groupBy("pair").agg(F.count(F.lit(1)).alias("n1"))


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(w, c): every word of two letters or more in all documents, with its count."""
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.char_length(w) > 1)
    return docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def ordinary_pairs(words: DataFrame) -> DataFrame:
    """(pair, n0) of words, as they are and joined with any other in snake and camel case: each is the first and the second of a name once."""
    w, c, low = F.col("w"), F.col("c").cast("double"), F.lower("w")
    first, last = F.substring(low, 1, 1), F.substring(low, -1, 1)
    form = lambda token, n: F.struct(token.alias("token"), n.alias("n"))
    forms = F.array(form(w, 2 * c), form(low, c), form(F.initcap(low), 2 * c), form(F.concat(last, F.lit("_")), c), form(F.concat(F.lit("_"), first), c))
    inside = with_pairs(words.select(F.explode(forms).alias("f")).select("f.token", "f.n"), "token", ["n"]).select("pair", "n")
    # The hump of a camel-case name: last and first letters meet by their shares.
    ends = words.groupBy(last.alias("z")).agg(F.sum(c).alias("n"))
    starts = words.groupBy(F.upper(first).alias("a")).agg(F.sum(c).alias("n"))
    starts = starts.select("a", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))  # a row for each letter
    humps = pair_grid(words.sparkSession).join(F.broadcast(ends), F.col("first") == F.col("z")).join(F.broadcast(starts), F.col("second") == F.col("a"))
    return inside.unionByName(humps.select("pair", (F.col("n") * F.col("share")).alias("n"))).groupBy("pair").agg(F.sum("n").alias("n0"))


def pair_grid(spark: SparkSession) -> DataFrame:
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    return spark.range(1).select(F.explode(letters).alias("first")).select("first", F.explode(letters).alias("second")).select("first", "second", F.concat("first", "second").alias("pair"))


def model(docs: DataFrame) -> DataFrame:
    """(pair, ratio): log of the pair's likelihood given its first character, in random strings over ordinary ones."""
    words = cut(ordinary_words(docs), "words")
    filled = pair_grid(docs.sparkSession).join(F.broadcast(random_pairs(docs.sparkSession)), "pair", "left").join(F.broadcast(ordinary_pairs(words)), "pair", "left")
    w = Window.partitionBy("first")
    count = lambda n: F.coalesce(F.col(n), F.lit(0))
    share = lambda n: F.log((count(n) + SMOOTH) / (F.sum(count(n)).over(w) + SMOOTH * len(ALPHABET)))
    return filled.select("pair", (share("n1") - share("n0")).alias("ratio"))


def likely(found: DataFrame, ratios: DataFrame) -> DataFrame:
    """Those candidates that the models take for random strings."""
    scored = with_pairs(found, "token", ["doc_id", "_th", "start", "end"]).join(F.broadcast(ratios), "pair")
    total = scored.groupBy("doc_id", "_th", "start", "end").agg(F.sum("ratio").alias("total"), F.avg("ratio").alias("mean"))
    return total.filter((F.col("total") >= LEAST_TOTAL) & (F.col("mean") >= LEAST_MEAN)).select("doc_id", "_th", F.lit("markov").alias("kind"), "start", "end")


def apart(spans: DataFrame) -> DataFrame:
    """Spans without those of the models that overlap a base span."""
    base = F.col("kind") != "markov"
    w = Window.partitionBy("doc_id", "_th").orderBy("start", "end", "kind")
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumn("_clear", clear).filter(base | F.col("_clear")).drop("_clear")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_th"), text.alias("text"))


def spans_by_row(rows: DataFrame) -> DataFrame:
    """(doc_id, _th, spans) of rows with any; spans are structs (start, k, end), k the kind's number, sorted."""
    base = None
    for kind, rule in BASE.items():
        found = places(rows, kind, *rule).drop("token")
        base = found if base is None else base.unionByName(found)
    ratios = cut(model(rows), "ratios")
    spans = apart(base.unionByName(likely(places(rows, "markov", CANDIDATE, 0, 20), ratios)))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return spans.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set(F.struct("start", number.alias("k"), "end"))).alias("spans"))


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, _th, spans) with overlapping spans as one, in order: structs (start, end). Spans of a row are spread out, so no array grows step by step."""
    flat = spans.select("doc_id", "_th", F.inline("spans"))
    w = Window.partitionBy("doc_id", "_th").orderBy("start", "end", "k")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("_first", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int"))
    flat = flat.withColumn("_run", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = flat.groupBy("doc_id", "_th", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): whole rows as structs, and their spans, merged, an empty array where there are none. Only rows with spans are shuffled, where these are few."""
    spans = cut(merged(spans_by_row(keyed(docs, id_col, text_col))), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_th"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))
    keys = small(spans.select("doc_id", "_th")).alias("k")
    some = held.alias("h").join(keys, same("h", "k"), "left_semi").alias("h").join(spans.alias("s"), same("h", "s")).select("h.row", "s.spans")
    none = held.alias("h").join(keys, same("h", "k"), "left_anti").select("h.row", F.array().cast(MERGED).alias("spans"))
    return some.unionByName(none)


def scan(docs: DataFrame) -> DataFrame:
    rows = keyed(docs)
    spans = spans_by_row(rows)
    out = rows.select("doc_id", "_th").alias("r").join(spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r._th") == F.col("s._th")), "left")
    out = out.select("r.doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return out.select("doc_id", n(1).alias("n_assign"), n(2).alias("n_access"), n(3).alias("n_hex"), F.sha2(joined(F.filter("spans", lambda s: s["k"] <= 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span of with_spans() replaced. The text is cut into pages first, so the time is in proportion to its length and the number of spans."""
    size = F.lit(PAGE).cast("long")
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    part = lambda page, a, n: F.substring(page, a.cast("int"), n.cast("int"))

    def between(p: Column, a: Column, b: Column) -> Column:
        """Characters a (from 0) up to b of the pages."""
        i, j = F.floor(a / size), F.floor((b - 1) / size)
        page = lambda k: F.element_at(p, (k + 1).cast("int"))
        many = F.concat(part(page(i), a % size + 1, size), F.array_join(F.slice(p, (i + 2).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int")), ""), part(page(j), F.lit(1), (b - 1) % size + 1))
        return F.when(a >= b, F.lit("")).when(i == j, part(page(i), a % size + 1, b - a)).otherwise(many)

    def whole(given: Column) -> Column:
        p, at = given["pages"], given["at"]
        count = F.size(at)
        end = lambda k: F.when(k > 0, F.element_at(at, F.greatest(k, F.lit(1)))["end"]).otherwise(F.lit(0).cast("long"))
        gaps = F.transform(at, lambda s, k: F.concat(between(p, end(k), s["start"]), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), between(p, end(count), F.char_length(text).cast("long")))

    # Pages and spans are bound once, as the variable of a lambda, not taken again for each span.
    given = F.struct(pages.alias("pages"), spans.alias("at"))
    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(F.array(given), whole), 1))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
