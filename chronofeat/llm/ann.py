"""Approximate nearest neighbours by largest inner product.

Vectors get one more coordinate so that inner product order is distance order, and are projected by a Gaussian
(2-stable) matrix to a few dimensions. One kd-tree over the projections of all candidates deals them to cells: its
cuts are medians of a sample of at most SAMPLE projected vectors, its boxes hold all rows. Cells are kept as blocks of at
most about BLOCK vectors; a cell with more, such as one of many equal vectors, has several. A query goes to the cells nearest in
the projection, in rounds of growing number, and verifies their vectors in double precision, until a chi-square test says
that an unseen vector nearer than its k-th best would almost surely have shown up: the squared projected distance over
the squared true one has DIMS degrees of freedom. Queries of near cells travel as blocks, one row for each cell that any of them
opens, with their k-th best so far: a block of candidates hands on what reaches it and nothing else, so rows follow the queries, not the cells.

Vectors whose distances are all alike (random ones of many dimensions) leave little to prune: most cells pass the test, and the
search verifies most of the table.

Defined cases: null vectors, and those that are zero or hold a null or a
non-finite component, take no part; a null id takes no part; of rows with the
same id the one with the smallest vector counts; vectors are only compared with
those of their own length; ties go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read

#: Dimensions of the projection; even, for the closed form of the chi-square distribution.
DIMS = 8
#: Probability of the stopping test.
SURE = 0.9
#: Vectors to a block, queries to a block, cells at most, vectors that the tree's cuts are taken from, cells of a query's first round.
BLOCK, QUERIES, CELLS, SAMPLE, FIRST = 2048, 256, 1 << 16, 1 << 17, 4
SCHEMA = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """Of even m degrees of freedom, by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def cell_size(rows: int) -> int:
    """Vectors to a cell: four times the root of all rows, so that small tables have a tree as well; BLOCK at most."""
    return min(BLOCK, math.ceil(4 * math.sqrt(rows)))


class Index:
    """Projection and kd-tree of the vectors of one length."""

    def __init__(self, dim: int, most: float, rows: int, seed: int = 11):
        self.dim, self.most, self.rows = dim, most, rows
        self.to = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, node up to the value, node above; a node under 0 is the cell -1 - node

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        norm2 = (x * x).sum(1)
        if query:  # scaled to the longest candidate's norm, which keeps the order of inner products
            return x * (self.most / np.sqrt(norm2))[:, None] @ self.to[:-1]
        return x @ self.to[:-1] + np.sqrt(np.maximum(self.most**2 - norm2, 0))[:, None] * self.to[-1]

    def grow(self, points: np.ndarray) -> None:
        """Cut the widest side at its median until there are enough cells, or no side is left to cut."""
        want, cells, todo = min(CELLS, -(-self.rows // cell_size(self.rows))), 1, [(np.arange(len(points)), None)]
        while todo:
            rows, place = todo.pop(0)
            x = points[rows]
            wide = x.max(0) - x.min(0) if len(x) else np.zeros(DIMS)
            node, axis = -1, int(np.argmax(wide))
            if cells < want and wide[axis] > 0:
                value = float(np.median(x[:, axis]))
                value = value if value < x[:, axis].max() else float(x[:, axis][x[:, axis] < value].max())
                low = x[:, axis] <= value
                node, cells = len(self.cuts), cells + 1
                self.cuts.append([axis, value, -1, -1])
                todo += [(rows[low], (node, 2)), (rows[~low], (node, 3))]
            if place:
                self.cuts[place[0]][place[1]] = node
        number = 0
        for cut_ in self.cuts:
            for side in (2, 3):
                if cut_[side] < 0:
                    number, cut_[side] = number + 1, -1 - number

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64) if self.cuts else np.full(len(points), -1)
        axis, value, low, high = (np.array(x) for x in zip(*self.cuts, strict=True)) if self.cuts else [np.empty(0)] * 4
        while (live := np.flatnonzero(node >= 0)).size:
            at = node[live]
            node[live] = np.where(points[live, axis[at]] <= value[at], low[at], high[at])
        return -1 - node

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of projected queries to the boxes."""
        out = np.zeros((len(points), len(self.lo)))
        for d in range(DIMS):
            gap = np.maximum(np.maximum(self.lo[None, :, d] - points[:, None, d], points[:, None, d] - self.hi[None, :, d]), 0)
            out += gap * gap
        return out


def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, rows in pdf.groupby("dim"):
        yield int(dim), rows, np.stack(rows["embedding"].to_numpy()).astype(float)


def indexes(v: DataFrame) -> dict[int, Index]:
    """An index for each length of vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    found = {r["dim"]: Index(r["dim"], r["most"], r["n"]) for r in v.groupBy("dim").agg(F.max(norm).alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return found
    share = F.element_at(F.create_map(*[F.lit(x) for d, i in found.items() for x in (d, max(1, -(-i.rows // SAMPLE)))]), F.col("dim"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, _, x in by_length(pdf):
                yield pd.DataFrame({"dim": dim, "p": list(found[dim].project(x))})

    sample = v.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), share) == 0).mapInPandas(run, "dim int, p array<double>").toPandas()  # about SAMPLE rows a length at most
    for dim, index in found.items():
        p = sample.loc[sample["dim"] == dim, "p"]
        index.grow(np.stack(p.to_numpy()) if len(p) else np.zeros((0, DIMS)))
    return found


def packed(rows: DataFrame, index: dict[int, Index], ids: str) -> DataFrame:
    """(dim, cell, part, n, ids, data, lo, hi): one row for each (dim, cell, part) of rows with vectors, and their projections' box."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids)
        x = np.stack(pdf["embedding"].to_numpy()).astype("<f8")
        p = index[int(key[0])].project(x)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "n": [len(x)], "ids": [pdf[ids].to_numpy().astype("<i8").tobytes()], "data": [x.tobytes()], "lo": [p.min(0)], "hi": [p.max(0)]})

    return rows.groupBy("dim", "cell", "part").applyInPandas(run, "dim int, cell int, part int, n int, ids binary, data binary, lo array<double>, hi array<double>")


def in_parts(rows: DataFrame, size: int, key: str) -> DataFrame:
    """rows with their part: cells of more than `size` rows are split by hash."""
    count = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))  # at most CELLS rows a length
    return rows.join(F.broadcast(count), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64(key, F.lit(3)), F.col("parts")).cast("int"))


def candidate_blocks(v: DataFrame, index: dict[int, Index]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, rows, x in by_length(pdf):
                yield rows.assign(cell=index[dim].cells(index[dim].project(x)))

    placed = v.select("dim", "vec_id", "embedding").mapInPandas(run, "dim int, vec_id long, embedding array<double>, cell int")
    return packed(in_parts(placed, BLOCK, "vec_id"), index, "vec_id")


def query_blocks(queries: DataFrame, index: dict[int, Index]) -> DataFrame:
    """(dim, block, ids, data): queries of near cells in blocks of about QUERIES."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, rows, x in by_length(pdf):
                yield rows.assign(cell=index[dim].cells(index[dim].project(x)))

    placed = queries.mapInPandas(place, "query_id long, dim int, embedding array<double>, cell int")
    count = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most CELLS rows a length
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = count.withColumn("before", F.coalesce(before, F.lit(0)))
    # A cell's queries are dealt to the blocks that its stretch of the running count touches.
    at = F.col("before") + F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("n"))
    dealt = placed.join(F.broadcast(starts), ["dim", "cell"]).withColumn("block", F.floor(at / QUERIES).cast("long"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype("<f8")
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [pdf["query_id"].to_numpy().astype("<i8").tobytes()], "data": [x.tobytes()]})

    return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block long, ids binary, data binary")


def member_blocks(blocks: DataFrame) -> DataFrame:
    """(query_id, dim, block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame({"query_id": np.frombuffer(r.ids, "<i8"), "dim": r.dim, "block": r.block})

    return blocks.select("dim", "block", "ids").mapInPandas(run, "query_id long, dim int, block long")


def routes(blocks: DataFrame, best: DataFrame, index: dict[int, Index], begin: int, end: int) -> DataFrame:
    """(dim, block, cell, at, kth): the cells of ranks begin to end - 1 by distance that queries of a block open, the places of those queries in the block, and their k-th best inner products so far (-inf: none).

    best: (dim, block, known), by query the k-th best so far.
    """
    limit = chi_square_quantile(SURE, DIMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                i, ids = index[int(r.dim)], np.frombuffer(r.ids, "<i8")
                q = np.frombuffer(r.data, "<f8").reshape(len(ids), -1)
                known = {x["query_id"]: x["kth"] for x in r.known} if r.known is not None else {}
                kth = np.array([known.get(x, -np.inf) for x in ids.tolist()])
                bound = i.bounds(i.project(q, True))
                order = np.argsort(bound, 1, kind="stable")[:, begin:end]
                # Squared distance of the k-th best once the query is scaled, infinite while there is none.
                far = 2 * i.most**2 - 2 * kth * i.most / np.sqrt((q * q).sum(1))
                at, j = np.nonzero(np.take_along_axis(bound, order, 1) <= limit * far[:, None])
                cells = order[at, j]
                by = np.argsort(cells, kind="stable")
                at, cells = at[by], cells[by]
                edge = np.flatnonzero(np.diff(cells, prepend=-1))
                parts = np.split(at, edge[1:]) if len(edge) else []
                if parts:
                    yield pd.DataFrame({"dim": r.dim, "block": r.block, "cell": cells[edge], "at": [p.astype("<i4").tobytes() for p in parts], "kth": [kth[p].astype("<f8").tobytes() for p in parts]})

    return blocks.join(best, ["dim", "block"], "left").mapInPandas(run, "dim int, block long, cell int, at binary, kth binary")


def best_of(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best candidates in a block that reach its least score: places of queries, ids, scores. Ids of candidates ascend."""
    dot = q @ c.T
    dot[qid[:, None] == cid[None]] = -np.inf
    # Products of a matrix may round equal vectors differently: those near the k-th best are computed one by one.
    slack = 1e-9 * (1 + np.abs(np.where(np.isinf(dot), 0, dot)).max())
    kth = np.partition(dot, -k, axis=1)[:, -k] if len(cid) > k else np.full(len(qid), -np.inf)
    at, row = np.nonzero((dot >= np.maximum(kth, least)[:, None] - slack) & ~np.isinf(dot))
    score = np.einsum("nd,nd->n", q[at], c[row])
    fine = score >= least[at]
    at, row, score = at[fine], row[fine], score[fine]
    return leaders(at, cid[row], score, k)


def leaders(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score, then id."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], score[keep]


def searched(asked: DataFrame, queries: DataFrame, blocks: DataFrame, index: dict[int, Index], k: int) -> DataFrame:
    """SCHEMA rows of the routed queries in their cells' blocks that reach the k-th best so far. Blocks of queries that come together in a task are folded before they are handed on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, rows in pdf.groupby(["dim", "block"]):
                first = rows.iloc[0]
                qid = np.frombuffer(first["q_ids"], "<i8")
                q = np.frombuffer(first["q_data"], "<f8").reshape(len(qid), -1)
                found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                for r in rows.itertuples(index=False):
                    some = np.frombuffer(r.at, "<i4").astype(np.int64)
                    ids = np.frombuffer(r.ids, "<i8")
                    at, cid, score = best_of(qid[some], q[some], ids, np.frombuffer(r.data, "<f8").reshape(len(ids), -1), k, np.frombuffer(r.kth, "<f8"))
                    found = leaders(*(np.concatenate(x) for x in zip(found, (some[at], cid, score), strict=True)), k)
                yield pd.DataFrame({"query_id": qid[found[0]], "vec_id": found[1], "score": found[2]})

    asked = asked.join(queries.select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), ["dim", "block"])
    return asked.join(blocks.select("dim", "cell", "ids", "data"), ["dim", "cell"]).mapInPandas(run, SCHEMA)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", opened: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. `opened` takes the rounds' frames of (dim, block, cell, at, kth)."""
    v = cut(valid(vectors, id_col, vec_col), "vectors")
    index = indexes(v)
    found = [v.sparkSession.createDataFrame([], SCHEMA)]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda: reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if index:
        blocks = cut(candidate_blocks(v, index), "blocks")
        boxes = blocks.groupBy("dim", "cell").agg(*[f(F.col(side)[d]).alias(f"{side}{d}") for side, f in (("lo", F.min), ("hi", F.max)) for d in range(DIMS)]).toPandas()  # at most CELLS rows a length
        for dim, i in index.items():
            own = boxes[boxes["dim"] == dim].set_index("cell").reindex(range(len(i.cuts) + 1))
            i.lo, i.hi = (own[[f"{side}{d}" for d in range(DIMS)]].fillna(np.inf).to_numpy() for side in ("lo", "hi"))
        asking = cut(query_blocks(v.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "embedding"), index), "queries")
        member = member_blocks(asking)
        begin, end, cells = 0, FIRST, max(len(i.cuts) + 1 for i in index.values())
        while begin < cells:
            kth = ranked().filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            best = kth.join(member, "query_id").groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))  # a block's queries at most
            asked = cut(routes(asking, best, index, begin, end), "asked")
            if opened is not None:
                opened.append(asked)
            found = [cut(found[0].unionByName(searched(asked, asking, blocks, index, k)), "found")]
            found = [cut(ranked().drop("rank"), "best")]
            begin, end = end, 4 * end
    return ranked().select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


SQL = {
    "op9_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
}
