"""Periodic runs of words, by Crochemore's partition refinement.

A run is a stretch of words with smallest period q and at least max(least, 2 q) words that no neighbouring
word extends. Words are numbered, and positions are put into classes of equal factors by length: the classes of
length l + 1 are those of length l, split by the class of the next position. Only the smaller classes of a
split act as splitters in the next step (of each class's parts, all but one of the largest), so a position is moved a logarithmic number
of times. A class's positions form a linked list; where neighbours of a class of length l lie l apart, a square with primitive
root l begins, and squares of one root length that begin side by side merge into one run. All documents of
a batch are refined together, one array operation for all of them at each length.

Each document is one row of a map without shuffle; a batch holds BATCH bytes or one longer text.

Defined cases: a null text has no words; a null id is not planted with repeats; rows that repeat an id or text are judged
each alone; empty texts have no runs and collapse to nothing; very long texts are refined whole, in time n log n and some hundred bytes of
memory a word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import read
from chronofeat.llm.suffixes import ragged

BATCH = 8 << 20
LEAST = 12


class Partition:
    """Classes of equal factors of one length, of all documents of a batch: members by class, and neighbours by position."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        n = len(ids)
        self.length, self.size = 1, size
        self.end = np.cumsum(size)
        self.doc = np.repeat(np.arange(len(size)), size)
        key = self.doc << 32 | ids
        self.order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[self.order]) != 0))
        self.start, self.many = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        first = np.flatnonzero(new)
        k = self.names = len(first)
        self.start[:k], self.many[:k] = first, np.diff(np.append(first, n))
        self.cls, self.place = np.empty(n + 1, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.cls[self.order], self.place[self.order] = np.cumsum(new) - 1, np.arange(n)
        self.next, self.prev = np.full(n + 1, -1), np.full(n + 1, -1)
        self.link(self.order, new)
        owner, sizes = self.doc[self.order[first]], self.many[:k]
        self.shared = np.bincount(owner, weights=np.where(sizes > 1, sizes, 0), minlength=len(size)).astype(np.int64)
        by = np.lexsort((-sizes, owner))
        largest = by[np.concatenate(([True], np.diff(owner[by]) != 0))]
        self.split = np.flatnonzero(~np.isin(self.cls[:n], largest))
        self.near: dict[int, list[np.ndarray]] = defaultdict(list)
        self.changed(self.order)

    def link(self, rows: np.ndarray, new: np.ndarray) -> None:
        """Chain rows, which come in order of their places, up to the next that is new."""
        go = ~np.append(new[1:], True)
        self.next[rows] = np.where(go, np.append(rows[1:], -1), -1)
        self.prev[rows] = np.where(new, -1, np.append(-1, rows[:-1]))

    def changed(self, rows: np.ndarray) -> None:
        """Keep rows by the distance to their neighbour, if a square of that root could begin there."""
        gap = self.next[rows] - rows
        ok = (self.next[rows] >= 0) & (gap >= self.length) & (rows + 2 * gap <= self.end[self.doc[rows]])
        rows, gap = rows[ok], gap[ok]
        by = np.argsort(gap, kind="stable")
        rows, gap = rows[by], gap[by]
        edge = np.flatnonzero(np.diff(gap, prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            self.near[int(gap[a])].append(rows[a:b])

    def squares(self, length: int) -> np.ndarray:
        """Where squares begin whose primitive root has this length: that of the classes, or any longer one once nothing splits."""
        at = np.unique(np.concatenate(self.near.pop(length)))
        return at[self.next[at] - at == length]

    def shed(self) -> None:
        """Drop the last position of each document, whose longer factor would leave it: it ends its class's chain."""
        last = self.end[self.size >= self.length] - self.length
        last = last[self.many[self.cls[last]] > 1]
        c = self.cls[last]
        self.next[self.prev[last]] = -1
        self.many[c] -= 1
        self.shared[self.doc[last]] -= 1 + (self.many[c] == 1)
        slot = self.start[c] + self.many[c]
        other = self.order[slot]
        self.order[self.place[last]], self.place[other] = other, self.place[last]
        self.order[slot], self.place[last] = last, slot

    def refine(self) -> bool:
        """On to factors of one word more; False once nothing splits any longer: from then on neighbours stay what they are."""
        moved = self.split[self.split > 0] - 1
        last = self.end[self.doc[moved]] - self.length
        open_ = (self.shared > 0) & (self.size >= 2 * self.length + 2)
        moved = moved[(self.doc[moved] == self.doc[moved + 1]) & (moved != last) & open_[self.doc[moved]]]
        self.shed()
        self.length += 1
        rows = moved[self.many[self.cls[moved]] > 1]
        self.split = np.empty(0, dtype=np.int64)
        if not len(rows):
            return False
        n, by, old = len(self.order), self.cls[rows + 1], self.cls[rows]
        bits = int(n).bit_length()
        if 3 * bits <= 63:
            key = np.sort((old << bits | by) << bits | rows)
            rows, by, old = key & (1 << bits) - 1, key >> bits & (1 << bits) - 1, key >> 2 * bits
        else:
            order = np.lexsort((rows, by, old))
            rows, by, old = rows[order], by[order], old[order]
        # Parts: rows that leave one class for the same reason; parents: the classes left.
        new_parent = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_parent | np.concatenate(([True], by[1:] != by[:-1]))
        first, parent_first = np.flatnonzero(new), np.flatnonzero(new_parent)
        size, left = np.diff(np.append(first, len(rows))), np.diff(np.append(parent_first, len(rows)))
        parents = old[parent_first]
        parent_of = np.cumsum(new_parent[first]) - 1
        was = self.many[parents]
        rest = was - left
        self.unlink(rows, old)
        self.make_room(rows, parents, left)
        # Of a parent's rest and parts the largest one splits nothing. Where nothing is left, it keeps the name.
        order = np.lexsort((-size, parent_of))
        largest = order[np.concatenate(([True], np.diff(parent_of[order]) != 0))]
        part_is_big = size[largest] > rest
        big, keeps = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
        big[largest[part_is_big]] = True
        keeps[largest[rest == 0]] = True
        name = np.where(keeps, old[first], 0)
        fresh = np.flatnonzero(~keeps)
        name[fresh] = self.names + np.arange(len(fresh))
        self.names += len(fresh)
        self.start[name] = self.start[old[first]] + rest[parent_of] + first - parent_first[parent_of]
        self.many[parents] = rest
        self.many[name] = size
        slot = np.repeat(self.start[name] - first, size) + np.arange(len(rows))
        self.order[slot], self.place[rows], self.cls[rows] = rows, slot, np.repeat(name, size)
        self.link(rows, new)
        self.changed(rows)
        shared = lambda x: np.where(x > 1, x, 0)
        np.add.at(self.shared, self.doc[rows[parent_first]], shared(rest) - was)
        np.add.at(self.shared, self.doc[rows[first]], shared(size))
        small = parents[part_is_big & (rest > 0)]
        self.split = np.concatenate((rows[np.repeat(~big, size)], self.order[ragged(self.start[small], self.many[small])]))
        return len(self.split) > 0

    def unlink(self, rows: np.ndarray, old: np.ndarray) -> None:
        """Take rows out of their classes' chains: those that stand side by side in a chain go at once."""
        order = np.lexsort((rows, old))
        r = rows[order]
        new = np.concatenate(([True], self.next[r[:-1]] != r[1:]))
        first = np.flatnonzero(new)
        before, after = self.prev[r[first]], self.next[r[np.append(first[1:], len(r)) - 1]]
        self.next[before], self.prev[after] = after, before  # -1 falls into the spare last place
        self.changed(before[before >= 0])

    def make_room(self, rows: np.ndarray, parents: np.ndarray, left: np.ndarray) -> None:
        """Members that stay change places with leaving ones, until those that leave a class stand at its end."""
        edge = self.start[parents] + self.many[parents] - left
        tail = self.order[ragged(edge, left)]
        stays = tail[~np.isin(tail, rows)]
        early = rows[self.place[rows] < np.repeat(edge, left)]
        self.place[early], self.place[stays] = self.place[stays], self.place[early].copy()
        self.order[self.place[early]], self.order[self.place[stays]] = early, stays


def runs_in(ids: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Rows (document, start in it, length, period) of all runs, by document, start and period."""
    if not len(ids):
        return np.empty((0, 4), dtype=np.int64)
    p, found = Partition(ids, size), []
    begin, going = p.end - size, True
    while True:
        for q in [p.length] if going else sorted(k for k in p.near if k >= p.length):
            at = p.squares(q) if q in p.near else ()
            if len(at):
                first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
                start, stop = at[first], at[np.append(first[1:], len(at)) - 1] + 2 * q
                start, stop = start[stop - start >= least], stop[stop - start >= least]
                doc = p.doc[start]
                found.append(np.stack((doc, start - begin[doc], stop - start, np.full(len(doc), q)), axis=1))
        if not going:
            break
        going = p.refine()
    runs = np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document of ten, by its id: which word stands at each place once a stretch repeats to its end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about BATCH bytes."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        b = t.as_py() or b""
        if texts and size + len(b) > BATCH:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(b)
        size += len(b)
    if texts:
        yield ids, texts


def periodic(docs: DataFrame, least: int = LEAST, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), and `collapsed`: the words that no run holds after its first period, joined by a space.

    With plant, every tenth document is first given a repeating stretch.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for ids, texts in batches_of(batch):
                number: dict[bytes, int] = defaultdict(count().__next__)
                words, coded = [], []
                for i, t in zip(ids, texts, strict=True):
                    w = t.split()
                    c = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))
                    take = planted(i, len(w)) if plant else None
                    if take is not None:
                        w, c = [w[j] for j in take.tolist()], c[take]
                    words.append(w)
                    coded.append(c)
                size = np.array(list(map(len, words)))
                runs = runs_in(np.concatenate(coded), size, least)
                per = np.bincount(runs[:, 0], minlength=len(size))
                edge = np.concatenate(([0], np.cumsum(per)))
                kept = []
                for k, w in enumerate(words):
                    if per[k]:
                        keep = np.ones(len(w), dtype=bool)
                        for _, s, n, q in runs[edge[k] : edge[k + 1]].tolist():
                            keep[s + q : s + n] = False
                        w = compress(w, keep.tolist())
                    kept.append(b" ".join(w))
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, j], pa.int64()) for j in (1, 2, 3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), lists, pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def listed(runs: Column) -> Column:
    """Every run as `start,length,period` and a line end."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(read(spark, sf_dir, "documents"), plant=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    found = found.withColumn("_best", best)
    n, s, q = F.col("_best.n"), -F.col("_best.s"), -F.col("_best.q")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        s.alias("start"),
        n.alias("length"),
        q.alias("period"),
        F.expr("1000 * _best.n div -_best.q").alias("exponent_milli"),
        F.sha2(F.encode(listed(F.col("runs")), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
