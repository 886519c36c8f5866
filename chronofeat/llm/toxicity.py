"""Toxicity by maximum-scoring segments.

Training: token counts of toxic and other labelled documents give log-odds with an informative
Dirichlet prior (the counts of both together); tokens whose z-score is large are kept with
their log-odds, all others cost a little. Scoring: one linear pass over a document's tokens finds
all maximal scoring segments. Calibration: under the other documents' token frequencies the largest
segment of n tokens follows an extreme-value law, so each segment has a p-value; passages with
small ones are significant, and their evidence is summed. A logistic curve through binned training
documents turns evidence into a probability.

Tokens are counted by hashes of 64 bits. The TASK_TOKENS commonest tokens with evidence go to every task; the others, if there are
more, reach the texts that hold them by a join, so no token that passes the tests is left out and what a task holds is bounded. Token counts and
calibration cover all labelled training rows; these are the rows whose id has a checksum crc32(id as text) that 5 doesn't divide.

Defined cases: a null text is empty, and an empty or wordless text has no evidence; a null id counts as an
empty text for its checksum; labels that are null are ignored, and of several for an id the largest counts;
without toxic or without other training rows every score is 0; rows that repeat are scored each; very long texts are scored whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read, small
from chronofeat.llm.textnum import chunks, words

#: z-score and toxic documents that a token needs as evidence; log-odds are held within the last.
LEAST_Z, LEAST_DOCS, LARGEST = 3.0, 3, 6.0
#: Tokens with evidence that every task holds (16 bytes each).
TASK_TOKENS = 1 << 19
#: Weight of the prior, in tokens of the smaller class, and what a token without evidence costs.
PRIOR, COST = 1.0, 0.05
#: p-value under which a passage is significant.
SIGNIFICANT = 0.05
BINS = 200
EULER = 0.5772156649


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.crc32(key) % 5 == 0).alias("held_out"))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the text that it is of."""
    h, at, _, _ = words(texts, "alnum")
    return h.view(np.int64), at


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic tokens, other tokens, toxic documents) over rows of (text, toxic)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toxic = pdf["toxic"].to_numpy() > 0
            for start, texts in chunks(pdf["text"].tolist()):
                h, at = tokens_of(texts)
                y = toxic[start + at]
                token, inverse = np.unique(h, return_inverse=True)
                seen = np.unique(np.stack((inverse, at), 1)[y], axis=0)[:, 0] if y.any() else np.empty(0, dtype=np.int64)
                n = len(token)
                yield pd.DataFrame({"token": token, "n1": np.bincount(inverse[y], minlength=n), "n0": np.bincount(inverse[~y], minlength=n), "d1": np.bincount(seen, minlength=n)})

    counted = rows.select("text", "toxic").mapInPandas(run, "token long, n1 long, n0 long, d1 long")
    return counted.groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("d1").alias("d1"))


def log_odds(counts: DataFrame) -> dict:
    """The tokens with evidence and their scores: the commonest as arrays ordered by token, others as the table `rest`, None if there are none; `rate` is None where nothing can be learned."""
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    n1, n0 = total["n1"] or 0, total["n0"] or 0
    model = {"token": np.empty(0, dtype=np.int64), "score": np.empty(0), "rest": None, "rate": None}
    if not n1 or not n0:
        return model
    weight = PRIOR * min(n1, n0)
    prior = F.lit(weight) * (F.col("n1") + F.col("n0")) / (n1 + n0)
    a, b = F.col("n1") + prior, F.col("n0") + prior
    scored = counts.withColumn("score", F.log(a / (n1 + weight - a)) - F.log(b / (n0 + weight - b))).withColumn("z", F.col("score") / F.sqrt(1 / a + 1 / b))
    kept = scored.filter((F.abs("z") >= LEAST_Z) & ((F.col("d1") >= LEAST_DOCS) | (F.col("score") < 0)))
    kept = cut(kept.select("token", F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), "score")).alias("score"), "n0", (F.col("n0") + F.col("n1")).alias("n")), "evidence")
    held = kept
    if kept.count() > TASK_TOKENS:
        held = kept.orderBy(F.desc("n"), "token").limit(TASK_TOKENS)
        last = held.orderBy("n", F.desc("token")).first()
        model["rest"] = kept.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("token") > last["token"]))).select("token", "score")
    held = sorted(held.select("token", "score").collect())  # at most TASK_TOKENS rows
    # Scores to a ten-thousandth: a number of rows that LARGEST bounds.
    level = kept.groupBy(F.round("score", 4).alias("score")).agg(F.sum((F.col("n0") + 0.5) / n0).alias("often")).orderBy("score").collect()
    rate = background_rate(np.array([r["score"] for r in level]), np.array([r["often"] for r in level]))
    return model | {"token": np.array([r["token"] for r in held], dtype=np.int64), "score": np.array([r["score"] for r in held], dtype=float), "rate": rate}


def with_rest(rows: DataFrame, model: dict) -> DataFrame:
    """rows of a text, with `rest`: (token, score) of those of its tokens that no task holds. Without such tokens nothing is read or shuffled."""
    kind = "array<struct<token:long,score:double>>"
    if model["rest"] is None:
        return rows.withColumn("rest", F.lit(None).cast(kind))
    held = model["token"]
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["_row"].to_numpy()
            for start, texts in chunks(pdf["text"].tolist()):
                h, at = tokens_of(texts)
                other = ~np.isin(h, held)
                found = np.unique(np.stack((at[other], h[other]), 1), axis=0)
                yield pd.DataFrame({"_row": ids[start + found[:, 0]], "token": found[:, 1]})

    seen = numbered.select("_row", "text").mapInPandas(run, "_row long, token long")
    own = seen.join(model["rest"], "token").groupBy("_row").agg(F.collect_list(F.struct("token", "score")).alias("rest"))
    return numbered.join(own, "_row", "left").drop("_row")


def background_rate(score: np.ndarray, often: np.ndarray) -> float:
    """The positive root r of sum p exp(r s) = 1 over the tokens of other documents."""
    rest = max(1e-9, 1 - often.sum())
    f = lambda r: rest * math.exp(-COST * r) + float((often * np.exp(r * score)).sum()) - 1
    if not (score > 0).any() or -COST * rest + float((often * score).sum()) >= 0:
        return 1.0
    hi = 1.0
    while f(hi) < 0 and hi < 200:
        hi *= 2
    lo = 0.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return max(hi, 1e-3)


def maximal_segments(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in time linear in their number: (first, last, score) in positive tokens, given the running sums before and after each."""
    left, right, first, last, back = [], [], [], [], []
    for k, (lo, hi) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
        start, j = k, len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, start = left[j], first[j]
            nxt = back[j]
            del left[j:], right[j:], first[j:], last[j:], back[j:]
            j = nxt
        left.append(lo)
        right.append(hi)
        first.append(start)
        last.append(k)
        back.append(j)
    return [(a, b, r - x) for a, b, r, x in zip(first, last, right, left, strict=True)]


def set_scores(s: np.ndarray, h: np.ndarray, token: np.ndarray, score: np.ndarray) -> None:
    """Put into s the scores of those of the hashes h that are among the ordered tokens."""
    if len(token):
        where = np.minimum(np.searchsorted(token, h), len(token) - 1)
        hit = token[where] == h
        s[hit] = score[where[hit]]


def segments(token: np.ndarray, score: np.ndarray, texts: list[bytes], rest: list) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text: number of tokens, and (first token, last token, score) of its maximal segments. rest: with_rest()'s value of each text."""
    h, at = tokens_of(texts)
    s = np.full(len(h), -COST)
    set_scores(s, h, token, score)
    bounds = np.searchsorted(at, np.arange(len(texts) + 1))
    for i, own in enumerate(rest):
        if own is not None and len(own):
            pairs = sorted((r["token"], r["score"]) for r in own)
            here = slice(bounds[i], bounds[i + 1])
            set_scores(s[here], h[here], np.array([t for t, _ in pairs], dtype=np.int64), np.array([x for _, x in pairs]))
    total = np.concatenate(([0.0], np.cumsum(s)))
    positive = np.flatnonzero(s > 0)
    cuts = np.searchsorted(positive, bounds)
    for i in range(len(texts)):
        p = positive[cuts[i] : cuts[i + 1]]
        found = [(int(p[a] - bounds[i]), int(p[b] - bounds[i]), x) for a, b, x in maximal_segments(total[p], total[p + 1])] if len(p) else []
        yield int(bounds[i + 1] - bounds[i]), found


def evidence(model: dict, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed -ln p of the significant passages, or that of the best one if none is; and the significant passages."""
    best, total, kept = 0.0, 0.0, []
    for a, b, x in found:
        e = math.exp(min(50.0, model["log_k"] + math.log(n) - model["rate"] * x))
        lnp = -math.log(-math.expm1(-e)) if e > 1e-12 else -math.log(e) if e > 0 else 700.0
        best = max(best, lnp)
        if lnp > -math.log(SIGNIFICANT):
            total += lnp
            kept.append((a, b, x))
    return max(best, total), kept


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """docs: rows of texts_of(); labels: doc_id, toxic."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = docs.filter(~F.col("held_out")).join(small(cut(known, "labels")), "doc_id")
    model = log_odds(cut(token_counts(rows), "counts"))
    if model["rate"] is None:
        return model
    token, score = model["token"], model["score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toxic = pdf["toxic"].to_numpy()
            for start, texts in chunks(pdf["text"].tolist()):
                got = list(segments(token, score, texts, pdf["rest"].iloc[start : start + len(texts)].tolist()))
                yield pd.DataFrame({"toxic": toxic[start : start + len(texts)], "n": [n for n, _ in got], "scores": [[x for _, _, x in f] for _, f in got]})

    scored = cut(with_rest(rows.select("text", "toxic"), model).mapInPandas(run, "toxic int, n long, scores array<double>"), "scored")
    other = scored.filter("toxic = 0 AND n > 0 AND size(scores) > 0").agg(F.avg(F.array_max("scores") * model["rate"] - F.log(F.col("n").cast("double"))).alias("m")).first()["m"]
    model["log_k"] = (other if other is not None else 0.0) - EULER
    law = {k: model[k] for k in ("rate", "log_k")}

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [feature(evidence(law, max(n, 1), [(0, 0, s) for s in scores])[0]) for n, scores in zip(pdf["n"], pdf["scores"], strict=True)]
            yield pd.DataFrame({"bin": np.minimum((np.array(x) * 20).astype(int), BINS), "toxic": pdf["toxic"]})

    table = scored.mapInPandas(bins, "bin int, toxic int").groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 x BINS rows
    model["a"], model["b"] = logistic([((r["bin"] + 0.5) / 20, r["toxic"] > 0, r["n"]) for r in table])
    return model


def feature(x: float) -> float:
    return math.log1p(x)


def logistic(rows: list[tuple[float, bool, int]]) -> tuple[float, float]:
    """Newton's method for P(toxic) = 1 / (1 + exp(-(a + b x))), with a slight pull to 0 and b held at 0 or more."""
    x, y, w = (np.array(v, dtype=float) for v in zip(*rows, strict=True))
    t = np.zeros(2)
    z = np.stack((np.ones_like(x), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        grad = z.T @ (w * (y - p)) - 1e-3 * t
        t = t + np.clip(np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2), grad), -2, 2)
    return float(t[0]), float(max(t[1], 0.0))


def score_rows(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (first and last token, score)."""
    token, known = model["token"], model["score"]
    law = {k: v for k, v in model.items() if k not in ("token", "score", "rest")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, texts in chunks(pdf["text"].tolist()):
                score, passages = [], []
                for n, found in segments(token, known, texts, pdf["rest"].iloc[start : start + len(texts)].tolist()):
                    if law["rate"] is None:
                        score.append(0.0)
                        passages.append([])
                        continue
                    x, kept = evidence(law, max(n, 1), found)
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, law["a"] + law["b"] * feature(x))))))
                    passages.append([{"first": a, "last": b, "score": s} for a, b, s in kept])
                rows = pdf.iloc[start : start + len(texts)]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(dtype=object), "held_out": rows["held_out"].to_numpy(), "score": score, "predicted": [int(x >= 0.5) for x in score], "passages": passages})

    return with_rest(docs, model).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:long,last:long,score:double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(read(spark, sf_dir, "documents"))
    return score_rows(docs, train(docs, read(spark, sf_dir, "labels"))).drop("passages")
