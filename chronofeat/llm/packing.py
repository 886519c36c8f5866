"""Best-fit packing by linear grouping.

Each document becomes token ids and an end id, and those over a sequence's length are
cut. Only the counts of piece lengths reach the driver, one number per possible
length. There, large lengths are sorted, cut into groups of equal cardinality and
rounded up to their group's largest; few-size configurations are chosen for the
rounded sizes by a subset-sum search under the largest size left; the actual lengths
take the rounded places; small lengths then go best-fit into what is left.
The plan is a list of runs (length, first rank, count, first sequence, offset): it
is as long as there are lengths and configurations, not documents. A piece
finds its run by its length and its rank among pieces of that length.

Defined cases: a null text is empty, and packs as its end id alone; null ids and
repeated rows are packed like others, each once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read
from chronofeat.llm.pretoken import Encoder

LENGTH = 2048
#: Lengths over this share of a sequence are large; number of groups that they are rounded to.
LARGE, GROUPS = 1 / 8, 128
SALTS = 64
MB = 1 << 20
ENCODERS: dict[str, Encoder] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_sizes(n: int, most: int) -> list[int]:
    """Of a document of n ids: whole pieces, and before them what doesn't fill one."""
    return [n] if n <= most else ([n % most] if n % most else []) + [most] * (n // most)


def pieces_of(docs: DataFrame, tokenizer: str, most: int = LENGTH, end_id: int = 0) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in ENCODERS:
            ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = ENCODERS[tokenizer]
        for pdf in batches:
            ids, texts, now, size = pdf["doc_id"].tolist(), pdf["text"].tolist(), [], 0
            out: list[tuple] = []
            for i, t in enumerate([*texts, None]):
                if i == len(texts) or size > MB:
                    for j, x in zip(now, encoder.encode([texts[j] for j in now]), strict=True):
                        x, start = np.append(x, np.uint32(end_id)).astype("<u4"), 0
                        for k, m in enumerate(piece_sizes(len(x), most)):
                            out.append((ids[j], k, start, m, zlib.crc32(x[start : start + m].tobytes())))
                            start += m
                    now, size = [], 0
                if i < len(texts):
                    now.append(i)
                    size += len(t)
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(run, PIECES)


def best_filling(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Numbers of groups (with repeats) whose sizes fill room best, by bounded subset sums; larger sizes first."""
    reach = np.full(room + 1, -1, dtype=np.int64)  # the group that first reached a sum
    reach[0] = len(sizes)
    took = np.zeros(room + 1, dtype=np.int64)
    for g, (s, n) in enumerate(zip(sizes, left, strict=True)):
        if not n or s > room:
            continue
        took[:] = 0
        for _ in range(min(n, room // s)):
            fresh = np.flatnonzero((reach[:-s] >= 0) & (reach[s:] < 0) & (took[:-s] < n)) if s <= room else []
            if not len(fresh):
                break
            reach[fresh + s], took[fresh + s] = g, took[fresh] + 1
        if reach[room] >= 0:
            break
    at, out = int(np.flatnonzero(reach >= 0)[-1]), []
    while at:
        g = int(reach[at])
        out.append(g)
        at -= sizes[g]
    return out


def plan(counts: dict[int, int], most: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place all pieces of the counted lengths; and the number of sequences."""
    rank = dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, count)
    total = 0

    def put(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, rank[length], n, seq, offset))
        rank[length] += n

    large = [(x, n) for x, n in sorted(counts.items(), reverse=True) if x > most * LARGE and n]
    each = max(1, -(-sum(n for _, n in large) // GROUPS))
    groups: list[list[list[int]]] = [[]]  # of [length, count], longest first
    held = 0
    for x, n in large:
        while n:
            if held == each:
                groups.append([])
                held = 0
            m = min(n, each - held)
            groups[-1].append([x, m])
            held, n = held + m, n - m
    groups = [g for g in groups if g]
    sizes, left = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    for g in range(len(groups)):
        while left[g]:
            left[g] -= 1
            config = [g, *best_filling(sizes, left, most - sizes[g])]
            left[g] += 1
            use = {k: config.count(k) for k in config}
            times = min(left[k] // m for k, m in use.items())
            for k, m in use.items():
                left[k] -= m * times
            while times:  # the actual lengths take the places, as many sequences at once as are alike
                need: dict[int, int] = {}
                for k in config:
                    need[k] = need.get(k, 0) + 1
                n = times
                for k, m in need.items():
                    n = min(n, groups[k][0][1] // m) if groups[k][0][1] >= m else 0
                n = max(n, 1)
                offset, room = 0, most
                for k in config:
                    got, todo = offset, n
                    if groups[k][0][1] >= n:
                        x = groups[k][0][0]
                        put(x, n, total, offset)
                        groups[k][0][1] -= n
                        if not groups[k][0][1]:
                            groups[k].pop(0)
                        offset = got + x
                    else:
                        raise AssertionError(todo)
                bins.setdefault(room - offset, []).append((total, n))
                total, times = total + n, times - n
    small = sorted(((x, n) for x, n in counts.items() if x <= most * LARGE and n), reverse=True)
    for x, n in small:
        while n:
            fit = min((r for r in bins if r >= x), default=None)
            if fit is None:
                fit, fresh = most, -(-n // (most // x))
                bins[most] = [(total, fresh)]
                total += fresh
            seq, many = bins[fit].pop()
            if not bins[fit]:
                del bins[fit]
            k = min(fit // x, n)
            full = min(many, n // k)
            for j in range(k):
                put(x, full, seq, most - fit + j * x)
            n -= full * k
            bins.setdefault(fit - k * x, []).append((seq, full))
            if many > full:
                bins.setdefault(fit, []).append((seq + full, many - full))
    return np.array(runs, dtype=np.int64).reshape(-1, 5), total


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = LENGTH, end_id: int = 0) -> DataFrame:
    pieces = cut(pieces_of(docs, tokenizer or default_tokenizer(), most, end_id), "pieces")
    # Whole pieces fill a sequence each; all others are ranked within their length, salted so that a common length is no hot group.
    part = pieces.filter(F.col("length") < most).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = part.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    runs, used = plan(hist, most)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(firsts), ["length", "salt"])  # at most `most` x SALTS rows
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("first")).alias("rank"))
    keys = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = runs[np.searchsorted(keys, pdf["length"].to_numpy() << 44 | pdf["rank"].to_numpy(), side="right") - 1] if len(pdf) else runs[:0]
            pdf["sequence_id"], pdf["offset"] = r[:, 3] + pdf["rank"].to_numpy() - r[:, 1], r[:, 4]
            yield pdf.drop(columns="rank").astype({"doc_id": "Int64"})

    placed = ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
    whole = pieces.filter(F.col("length") == most).select(*pieces.columns, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
