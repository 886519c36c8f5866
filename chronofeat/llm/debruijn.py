"""Substring dedup by de Bruijn compaction: windows of WINDOW words that start in an earlier document are removed.

1. Edges. Each window of k words is an edge of the de Bruijn graph, from its first k - 1 words to its last k - 1; it is named by a
   hash. Edges are dealt by name, each batch's in one packed blob per deal. A deal keeps the edges that several
   documents hold; the least document with it, and its place there, is an edge's source coordinate. Its occurrences in later documents go on.
2. Stretches. A document's occurrences that follow one another along one source are one stretch: a walk on the graph.
3. Compaction. A source's path branches where some walk enters or leaves it. Stretches are joined to their source's
   branching places, between which lie the nonbranching paths: every walk runs through all of such a path or none of it.
4. Verification. A path's words are digested once, at its source coordinates, and again wherever a walk runs through it; only where the digests agree
   are words removed. Windows that fail, by a collision of names, are looked up once more among all
   windows of their name by a digest of their words, so that results don't depend on hashes of 64 bits.

Whole copies of a text are settled first, by their digest. Edges of a passage that a third of all documents share are as many keys as it has
windows, each folded to a few bytes an occurrence; a path's digest travels by broadcast if counted small, else by a shuffle.

Defined cases: a null text has no words; a null id counts as larger than any other; rows that repeat an id are judged
each by its text, and remove nothing from one another; texts of fewer words than a window stay whole; very long texts are read whole, in some
hundred bytes of memory a word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import BROADCAST_ROWS, cut, read, small
from chronofeat.llm.deals import dealt, freeze, thaw
from chronofeat.llm.suffixes import merge
from chronofeat.llm.textnum import U, mix

WINDOW = 13
#: Bytes of a path's digest; bytes of a side up to which it is broadcast.
DIGEST, BROADCAST_BYTES = 16, 32 << 20
#: Edges that a task packs at a time; words whose hashes it remembers; bits of an edge's name.
PACKED, WORDS, BITS = 1_000_000, 200_000, 64
NONE = np.iinfo(np.int64).max


class Names(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def edge_names(h: np.ndarray, doc: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Name of each window of k words of one document, and where it starts, of hashes of words and numbers of their documents."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    g = np.zeros(m, dtype=U)
    for j in range(k):
        g *= U(0xD6E8FEB86659FD93)
        g += h[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return mix(g[at]) >> U(64 - bits), at


def slices(given: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, so that little but what is read is held at a time."""
    for batch in given:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(doc_id, th, words) of each row (doc_id, th, text, ...)."""
    for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield i, t, text.as_py().split()


def named_windows(given: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, ths, first word of each document, names, places among all words) of some PACKED windows."""
    names, ids, ths, hashes, held = Names(), [], [], [], 0

    def out() -> tuple[np.ndarray, ...]:
        size = np.array(list(map(len, hashes)))
        name, at = edge_names(np.concatenate(hashes), np.repeat(np.arange(len(size), dtype=np.int32), size), k, bits)
        return np.array(ids, dtype=np.int64), np.array(ths, dtype=np.int64), np.cumsum(size) - size, name, at

    for batch in given:
        for i, t, words in texts_of(batch):
            if len(words) < k:
                continue
            ids.append(i)
            ths.append(t)
            hashes.append(np.fromiter(map(names.__getitem__, words), dtype=U, count=len(words)))
            held += len(words)
            if held >= PACKED:
                yield out()
                ids, ths, hashes, held = [], [], [], 0
    if ids:
        yield out()


def packed(tables: list[list[np.ndarray]], columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Tables of 8-byte integers, then columns."""
    heads = [freeze([(np.diff(x, prepend=0).view(U), 8) for x in t]) for t in tables]
    return b"".join([*(len(b).to_bytes(4, "little") + b for b in heads), freeze(columns)])


def unpacked(b: bytes, tables: list[int], widths: list[int]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    out = []
    for n in tables:
        size = int.from_bytes(b[:4], "little")
        out.append([np.cumsum(x.view(np.int64)) for x in thaw(b[4 : 4 + size], [8] * n)[0]])
        b = b[4 + size :]
    return out, [x.view(np.int64) for x in thaw(b, widths)[0]]


def edge_rows(docs: DataFrame, k: int, bits: int, deals: int) -> DataFrame:
    """(deal, blob): edges by deal, as documents and their first words, then names and places."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ths, begin, name, at in named_windows(given, k, bits):
            rows = []
            for deal, r in dealt((name % U(deals)).astype(np.int64)):
                doc = np.searchsorted(begin, at[r], side="right") - 1
                d = doc[np.flatnonzero(np.diff(doc, prepend=-1))]
                rows.append((deal, packed([[ids[d], ths[d], begin[d]]], [(name[r] // U(deals), 8), (np.diff(at[r], prepend=0).view(U), 4)])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["deal", "blob"])

    return docs.mapInArrow(run, "deal int, blob binary")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def repeated_edges(edges: DataFrame, deals: int) -> DataFrame:
    """(deal, blob): occurrences of edges in documents later than their source, by document: document, place, source, place there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for b in pdf["blob"]:
            [[ids, ths, begin]], [name, at] = unpacked(b, [3], [8, 4])
            at = np.cumsum(at)
            doc = np.searchsorted(begin, at, side="right") - 1
            got.append((name, ids[doc], ths[doc], (at - begin[doc]).astype(np.int32)))
        name, doc, th, at = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(name)
        same = name[order[1:]] == name[order[:-1]]
        some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        name, doc, th, at = name[some], doc[some], th[some], at[some]
        order = np.lexsort((at, th, doc, name))
        name, doc, th, at = name[order], doc[order], th[order], at[order]
        first = np.flatnonzero(changes(name))
        source = np.repeat(first, np.diff(np.append(first, len(name))))
        late = np.flatnonzero(doc > doc[source])
        source = source[late]
        late_doc, late_th, late_at = doc[late], th[late], at[late]
        rows = []
        for deal, r in dealt((mix(late_doc.view(U) ^ mix(late_th.view(U))) % U(deals)).astype(np.int64)):
            r = r[np.lexsort((late_at[r], late_th[r], late_doc[r]))]
            new = changes(late_doc[r], late_th[r])
            d = r[np.flatnonzero(new)]
            s = source[r]
            order = np.lexsort((th[s], doc[s]))
            new_source = changes(doc[s[order]], th[s[order]])
            number = np.empty(len(r), dtype=np.int64)
            number[order] = np.cumsum(new_source) - 1
            t = s[order][np.flatnonzero(new_source)]
            columns = [(new.astype(U), 1), (late_at[r].astype(U), 4), (number.astype(U), 4), (at[s].astype(U), 4)]
            rows.append((deal, packed([[late_doc[d], late_th[d]], [doc[t], th[t]]], columns)))
        return pd.DataFrame(rows, columns=["deal", "blob"])

    return edges.groupBy("deal").applyInPandas(run, "deal int, blob binary")


STRETCH = ("doc_id", "th", "start", "n", "src", "src_th", "src_at")


def stretches(occurrences: DataFrame) -> DataFrame:
    """Walks along one source: n edges from word `start` of a document on, which are those from `src_at` of the source on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for b in pdf["blob"]:
            [[ids, ths], [sources, source_ths]], [new, at, number, source_at] = unpacked(b, [2, 2], [1, 4, 4, 4])
            doc = np.cumsum(new) - 1
            got.append((ids[doc], ths[doc], at, sources[number], source_ths[number], source_at))
        doc, th, at, source, source_th, source_at = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((at, th, doc))
        doc, th, at, source, source_th, source_at = (x[order] for x in (doc, th, at, source, source_th, source_at))
        once = changes(doc, th, at)  # rows alike in id and text tell the same twice
        doc, th, at, source, source_th, source_at = (x[once] for x in (doc, th, at, source, source_th, source_at))
        step = np.arange(len(at))
        first = np.flatnonzero(changes(doc, th, source, source_th, at - step, source_at - step))
        n = np.diff(np.append(first, len(at)))
        return pd.DataFrame(dict(zip(STRETCH, (doc[first], th[first], at[first], n, source[first], source_th[first], source_at[first]), strict=True)))

    return occurrences.groupBy("deal").applyInPandas(run, "doc_id long, th long, start int, n int, src long, src_th long, src_at int")


def bounded(df: DataFrame, size) -> DataFrame:
    """df to be broadcast if its rows and bytes, counted, are within bounds; else as it is, for a shuffled join."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= BROADCAST_ROWS and found["b"] + 24 * found["n"] <= BROADCAST_BYTES else df


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=DIGEST).digest()


def paths(docs: DataFrame, walks: DataFrame, k: int) -> DataFrame:
    """(src, src_th, cuts, digests): each source's branching places, and a digest of the words of each path between them."""
    cuts = walks.select("src", "src_th", F.explode(F.array("src_at", F.col("src_at") + F.col("n"))).alias("cut"))
    cuts = cut(cuts.groupBy("src", "src_th").agg(F.array_sort(F.collect_set("cut")).alias("cuts")), "cuts")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(given):
            found = []
            for (_, _, words), places in zip(texts_of(batch), batch.column(3).to_pylist(), strict=True):
                found.append(b"".join(digest(words[a : b + k - 1]) for a, b in zip(places[:-1], places[1:], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.binary())], ["src", "src_th", "cuts", "digests"])

    side = bounded(cuts, 4 * F.size("cuts")).withColumnsRenamed({"src": "doc_id", "src_th": "th"})
    return docs.join(side, ["doc_id", "th"]).mapInArrow(run, "src long, src_th long, cuts array<int>, digests binary").dropDuplicates(["src", "src_th"])


def verified(docs: DataFrame, walks: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, spans, failed): word spans, as packed 32-bit starts and ends, whose words are those of their paths; places of windows that have the name of others only."""
    known = cut(paths(docs, walks, k), "paths")
    joined = walks.join(bounded(known, 4 * F.size("cuts") + F.octet_length("digests")), ["src", "src_th"])
    a, b = F.array_position("cuts", F.col("src_at")), F.array_position("cuts", F.col("src_at") + F.col("n"))
    joined = joined.withColumns({"_a": a.cast("int"), "_b": b.cast("int")})
    walk = F.struct((F.col("start") - F.col("src_at")).alias("by"), F.slice("cuts", F.col("_a"), F.col("_b") - F.col("_a") + 1).alias("cuts"), F.substring("digests", (F.col("_a") - 1) * DIGEST + 1, (F.col("_b") - F.col("_a")) * DIGEST).alias("digests"))
    of_doc = cut(joined.groupBy("doc_id", "th").agg(F.collect_list(walk).alias("walks")), "walks")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(given):
            spans, failed = [], []
            for (_, _, words), some in zip(texts_of(batch), batch.column(3), strict=True):
                start, stop, bad = [], [], []
                for w in some.as_py():
                    by, places, given_digests = w["by"], w["cuts"], w["digests"]
                    for j, (x, y) in enumerate(zip(places[:-1], places[1:], strict=True)):
                        if digest(words[x + by : y + by + k - 1]) == given_digests[j * DIGEST : (j + 1) * DIGEST]:
                            start.append(x + by)
                            stop.append(y + by + k - 1)
                        else:
                            bad += range(x + by, y + by)
                s, e = merge(np.array(start, dtype=np.int64), np.array(stop, dtype=np.int64))
                spans.append(s.astype("<i4").tobytes() + e.astype("<i4").tobytes())
                failed.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary()), pa.array(failed, pa.list_(pa.int32()))], ["doc_id", "th", "spans", "failed"])

    # Only texts with walks are shuffled, where their ids are few enough to say so; walks are hashed, so texts are not sorted.
    some = docs.join(small(of_doc.select("doc_id", "th")), ["doc_id", "th"], "left_semi")
    return some.join(of_doc.hint("shuffle_hash"), ["doc_id", "th"]).mapInArrow(run, "doc_id long, th long, spans binary, failed array<int>").dropDuplicates(["doc_id", "th"])


def looked_up(docs: DataFrame, failed: DataFrame, k: int, bits: int) -> DataFrame:
    """(doc_id, th, spans) of windows that an earlier document holds, of all those that have the name of a failed one (doc_id, th, at): by digests of their words."""

    def name(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ths, begin, names, at in named_windows(given, k, bits):
            doc = np.searchsorted(begin, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ths[doc]), pa.array((at - begin[doc]).astype(np.int32)), pa.array(names.view(np.int64))], ["doc_id", "th", "at", "name"])

    def words_of(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            found = [[digest(words[i : i + k]) for i in places] for (_, _, words), places in zip(texts_of(batch), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "th", "ats", "digests"])

    windows = docs.mapInArrow(name, "doc_id long, th long, at int, name long")
    some = docs.join(small(failed.select("doc_id", "th").distinct()), ["doc_id", "th"], "left_semi").mapInArrow(name, "doc_id long, th long, at int, name long")
    names = cut(some.join(small(failed), ["doc_id", "th", "at"], "left_semi").select("name").distinct(), "names")
    places = windows.join(small(names), "name", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats"))
    found = docs.join(cut(places, "places"), ["doc_id", "th"]).mapInArrow(words_of, "doc_id long, th long, ats array<int>, digests array<binary>").dropDuplicates(["doc_id", "th"])
    found = cut(found.select("doc_id", "th", F.inline(F.arrays_zip(F.col("ats").alias("at"), F.col("digests").alias("digest")))), "windows")
    least = found.groupBy("digest").agg(F.min("doc_id").alias("least"))
    late = found.join(least, "digest").filter("doc_id > least").groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats"))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            spans = []
            for ats in batch.column(2).to_pylist():
                s = np.array(ats, dtype=np.int64)
                s, e = merge(s, s + k)
                spans.append(s.astype("<i4").tobytes() + e.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], ["doc_id", "th", "spans"])

    return late.mapInArrow(run, "doc_id long, th long, spans binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay joined by a space, of every row."""
    spark, k = docs.sparkSession, window
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NONE))).alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    light = rows.select("doc_id", "th", F.sha2("text", 256).alias("digest"))
    firsts = light.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    copies = cut(light.join(small(cut(firsts, "firsts")), "digest").filter("doc_id > least").select("doc_id", "th").distinct(), "copies")
    rest = rows.join(small(copies), ["doc_id", "th"], "left_anti")
    deals = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    walks = cut(stretches(repeated_edges(edge_rows(rest, k, bits, deals), deals)), "walks")
    found = cut(verified(rest, walks, k), "spans")
    spans = found.select("doc_id", "th", "spans")
    failed = found.select("doc_id", "th", F.explode("failed").alias("at"))
    if failed.limit(1).count():
        spans = spans.unionByName(looked_up(rest, cut(failed, "failed"), k, bits))
    whole = np.array([0, np.iinfo(np.int32).max], dtype="<i4").tobytes()
    spans = spans.unionByName(copies.withColumn("spans", F.lit(whole)))
    spans = cut(spans.groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans")), "removed")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(given):
            ids, sizes, removed, kept = [], [], [], []
            for (i, _, words), some in zip(texts_of(batch), batch.column(3), strict=True):
                n, rest = len(words), words
                if some.is_valid and n >= k:
                    s, e = (np.concatenate(x) for x in zip(*(np.frombuffer(b, dtype="<i4").reshape(2, -1) for b in some.as_py()), strict=True))
                    rest, done = [], 0
                    for a, b in zip(*(x.tolist() for x in merge(s.astype(np.int64), e.astype(np.int64))), strict=True):
                        rest += words[done:a]
                        done = b
                    rest += words[done:]
                ids.append(None if i == NONE else i)
                sizes.append(n)
                removed.append(n - len(rest))
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    side = bounded(spans, F.aggregate("spans", F.lit(0), lambda n, b: n + F.octet_length(b)))
    out = rows.join(side, ["doc_id", "th"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op13_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS x FROM p),
m AS (SELECT x, min(doc_id) AS f FROM s GROUP BY x),
r AS (SELECT doc_id, i FROM s JOIN m USING (x) WHERE doc_id > f),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
e AS (SELECT doc_id, count(*) AS n, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.j = g.j GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(e.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
}
