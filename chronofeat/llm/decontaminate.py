"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Every n-gram of a test item that some document holds is a seed; of every run of RUN neighbouring ones that in the
fewest documents is a rare seed. Frequencies count all documents. So each item keeps rare seeds along its whole length
however widely it has leaked, and copies edited in different places keep those that each has left. One rare seed, or
several others that a document holds on neighbouring diagonals, mark a passage, which is
aligned with the item word by word (a match scores 2, a mismatch or gap costs 1). The score is the
best local alignment's share of a full match, from 0 to 1; passages from LEAST on are reported, with the
words where they start and end.

Texts are read twice and never shuffled. Test items are broadcast in slices of at most
SLICE words; a larger benchmark takes more passes.

Items under WHOLE words are found where all their words stand in a row, and those with fewer words than a seed only in texts of
just their words; items without words match nothing.

Defined cases: null, empty and wordless texts hold nothing; very long texts are searched whole;
null ids are reported as null; rows that repeat are reported each; an empty table gives an empty
result; other columns are ignored. An item that is found several times in a document is reported once, at its best place,
of equally good ones at that of the smallest diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read
from chronofeat.llm.textnum import chunks, ngrams, words

#: Words of a seed; n-grams to a run; seeds that a passage without a rare one needs (one, of items with few); share of a full match.
SEED, RUN, SEEDS, LEAST = 3, 4, 2, 0.5
WHOLE, SLICE = 5, 500_000
FOUND = "doc_id long, item long, score double, first_word long, last_word long, text_words long"


def item_words(items: list[str]) -> list[np.ndarray]:
    h, at, _, _ = words([t.encode() for t in items], "alnum")
    return np.split(h, np.searchsorted(at, np.arange(1, len(items))))


def item_grams(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, place) of all n-grams of items."""
    out = []
    for i, h in enumerate(items):
        if len(h) >= SEED:
            g, at = ngrams(h, np.zeros(len(h), dtype=np.int64), SEED)
            out.append((g, np.full(len(g), i), at))
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def document_counts(docs: DataFrame, grams: np.ndarray) -> np.ndarray:
    """Documents that hold each of the sorted grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grams), dtype=np.int64)
        for pdf in batches:
            for _, texts in chunks(pdf["text"].tolist()):
                h, at, _, _ = words(texts, "alnum")
                g, first = ngrams(h, at, SEED)
                where = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                hit = np.flatnonzero(grams[where] == g)
                once = np.unique(where[hit] * len(texts) + at[first[hit]])
                total += np.bincount(once // len(texts), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    out = np.zeros(len(grams), dtype=np.int64)
    for r in docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most SLICE rows
        out[r["gram"]] = r["n"]
    return out


def rare_seeds(gram: np.ndarray, item: np.ndarray, place: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Rows of the rarest n-gram of each run, given those that documents hold."""
    order = np.lexsort((place, often, place // RUN, item))
    run = item[order] * (1 << 32) + place[order] // RUN
    return order[np.concatenate(([True], run[1:] != run[:-1]))] if len(order) else order


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the last places in item and window."""
    steps = np.arange(len(window))
    h = np.zeros(len(window) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        now = np.maximum(np.maximum(h[:-1] + np.where(window == w, 2, -1), h[1:] - 1), 0)
        now = np.maximum.accumulate(now + steps) - steps
        h[1:] = now
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i, j)
    return best


def passages(h: np.ndarray, at: np.ndarray, n_texts: int, items: list[np.ndarray], seed: np.ndarray, item: np.ndarray, place: np.ndarray, rare: np.ndarray, seeds_of: np.ndarray) -> list[tuple]:
    """(text, item, score, first word, last word) of every passage found in a chunk of texts. seed is sorted, and may repeat."""
    g, first = ngrams(h, at, SEED)
    lo, hi = np.searchsorted(seed, g, "left"), np.searchsorted(seed, g, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    n = hi[hit] - lo[hit]
    stop = np.cumsum(n)
    row = np.arange(stop[-1]) + np.repeat(lo[hit] - (stop - n), n)
    pos = np.repeat(first[hit], n)
    start = np.searchsorted(at, np.arange(n_texts + 1))
    doc, it, p, scarce = at[pos], item[row], place[row], rare[row]
    diagonal = pos - start[doc] - p
    order = np.lexsort((diagonal, it, doc))
    doc, it, p, scarce, diagonal = doc[order], it[order], p[order], scarce[order], diagonal[order]
    length = np.array(list(map(len, items)))
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (np.diff(diagonal) > np.maximum(8, length[it[1:]] // 4))))
    bounds = np.append(np.flatnonzero(new), len(doc))
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        d, i = int(doc[a]), int(it[a])
        if not scarce[a:b].any() and len(np.unique(p[a:b])) < min(SEEDS, max(1, seeds_of[i] // 3)):
            continue
        m = len(items[i])
        slack = 8 + m // 8
        begin = start[d] + max(0, int(diagonal[a]) - slack)
        end = min(start[d + 1], start[d] + int(diagonal[b - 1]) + m + slack)
        window = h[begin:end]
        score, x, y = align(items[i], window)
        if score >= (LEAST if m >= WHOLE else 1) * 2 * m and score > best.get((d, i), (0,))[0]:
            _, _, back = align(items[i][x::-1], window[y::-1])
            best[d, i] = (score, score / (2 * m), int(begin - start[d] + y - back), int(begin - start[d] + y))
    return [(d, i, *v[1:]) for (d, i), v in best.items()]


def search(docs: DataFrame, texts: list[str]) -> DataFrame:
    """FOUND rows of one slice of test items; `item` is the number in texts."""
    items = item_words(texts)
    gram, item, place = item_grams(items)
    distinct, inverse = np.unique(gram, return_inverse=True)
    often = document_counts(docs, distinct)[inverse] if len(distinct) else np.empty(0, dtype=np.int64)
    held = np.flatnonzero(often)
    held = held[np.argsort(gram[held], kind="stable")]
    seed, item, place = gram[held], item[held], place[held]
    rare = np.zeros(len(held), dtype=bool)
    rare[rare_seeds(seed, item, place, often[held])] = True
    seeds_of = np.bincount(item, minlength=len(items))
    short: dict[bytes, list[int]] = {}
    for i, x in enumerate(items):
        if 0 < len(x) < SEED:
            short.setdefault(x.tobytes(), []).append(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, out = pdf["doc_id"].tolist(), []
            for begin, some in chunks(pdf["text"].tolist()):
                h, at, _, _ = words(some, "alnum")
                n = np.bincount(at, minlength=len(some))
                out += [(ids[begin + d], i, s, a, b, int(n[d])) for d, i, s, a, b in passages(h, at, len(some), items, seed, item, place, rare, seeds_of)]
                start = np.searchsorted(at, np.arange(len(some) + 1))
                for d in np.flatnonzero((n > 0) & (n < SEED)) if short else []:
                    out += [(ids[begin + d], i, 1.0, 0, int(n[d]) - 1, int(n[d])) for i in short.get(h[start[d] : start[d + 1]].tobytes(), [])]
            yield pd.DataFrame(out, columns=["doc_id", "item", "score", "first_word", "last_word", "text_words"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, text_words of every test item found in a document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    slices, found = max(1, -(-size // (6 * SLICE))), []
    for k in range(slices):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()  # a slice of bounded size
        ids = [r["item_id"] for r in own]
        got = search(docs, [r["text"] for r in own]) if own else docs.sparkSession.createDataFrame([], FOUND)
        pairs = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        found.append(got.join(F.broadcast(pairs), "item").select("doc_id", "item_id", "score", "first_word", "last_word", "text_words"))
    return reduce(DataFrame.unionByName, found)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), "leaks")
