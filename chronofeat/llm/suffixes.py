"""Suffix-array dedup: byte strings of LENGTH bytes that start in an earlier document are removed.

A suffix array of the whole corpus is built piece by piece where it matters:

1. Anchors. In every window of LENGTH bytes the GRAM-byte string with the least hash is its anchor, so
   equal windows have equal anchors, and about one position in fourteen is one. Anchors are dealt
   by hash; those whose gram occurs in one document only are dropped: their suffixes have no long
   common prefix with another document's.
2. Contexts. For each anchor left, the bytes of its windows are fetched. Occurrences whose whole context
   equals one of a smaller id are settled there and then, first within a batch, so that
   a passage that a third of all documents hold stays a small group. What is left is dealt by gram.
3. Deep-shallow sorting. In each deal the suffixes of differing contexts of one gram are sorted: by
   multikey quicksort (eight bytes a key) to the shallow depth, then, for groups with a longer common
   prefix, by blind tries, which branch on the first byte in which a group differs and skip all others.
   Suffixes that agree in LENGTH bytes end in one leaf; the smallest id there keeps its bytes, and all others lose them.
4. Byte spans by document are merged and cut out.

Each deal's size is the corpus over four times the shuffle partitions. Texts are shuffled once, to their anchors.

Defined cases: very long texts are read whole, each within one task; a null text is empty; a null id counts as larger than any other; rows that repeat an id
are judged each by its text, and remove nothing from one another; texts under LENGTH bytes stay whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import BROADCAST_ROWS, cut, read, small
from chronofeat.llm.deals import dealt, freeze, thaw
from chronofeat.llm.textnum import U, byte_codes, chunks, mix, powers

LENGTH, GRAM, SHALLOW = 50, 24, 16
#: Bytes of spans up to which they are broadcast to the texts.
BROADCAST_BYTES = 32 << 20
NONE = np.iinfo(np.int64).max


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Of the GRAM = 16 + 8 bytes from each position on."""
    h, size, held = byte_codes()[buf], 1, {}
    while size < 16:
        h = h[:-size] * U(0xD6E8FEB86659FD93 + 2 * size) + h[size:]
        size *= 2
        held[size] = h
    n = len(buf) - GRAM + 1
    return mix(held[16][:n] * U(0xA24BAED4963EE407) + held[8][16 : 16 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first window, last window) of all anchors; places are in their texts."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array(list(map(len, texts)))
    begin = np.concatenate(([0], np.cumsum(size)))
    if len(buf) < LENGTH:
        return tuple(np.empty(0, dtype=t) for t in (U, np.int64, np.int64, np.int64, np.int64))
    h = gram_hashes(buf)
    least, where, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < LENGTH - GRAM + 1:  # the leftmost least hash of each window, by doubling
        step = min(width, LENGTH - GRAM + 1 - width)
        right = least[step:] < least[: len(least) - step]
        where = np.where(right, where[step:], where[: len(where) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        width += step
    text = np.repeat(np.arange(len(texts)), np.maximum(size - LENGTH + 1, 0))
    n = np.maximum(size - LENGTH + 1, 0)
    stop = np.cumsum(n)
    p = np.arange(stop[-1]) + np.repeat(begin[:-1] - (stop - n), n) if len(n) else np.empty(0, dtype=np.int64)
    if not len(p):
        return tuple(np.empty(0, dtype=t) for t in (U, np.int64, np.int64, np.int64, np.int64))
    a = where[p].astype(np.int64)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(p)) - 1
    base = begin[text[lo]]
    return h[a[lo]], text[lo], a[lo] - base, p[lo] - base, p[hi] - base


def ids_of(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["doc_id"].to_numpy(dtype=np.int64)


def anchor_rows(docs: DataFrame, deals: int) -> DataFrame:
    """(deal, blob): anchors of each batch by deal, as hash, id, place, windows before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, got = ids_of(pdf), []
            for start, texts in chunks(pdf["text"].tolist()):
                h, text, a, lo, hi = anchors(texts)
                got.append((h, ids[start + text], a, a - lo, a - hi))
            if not got:
                continue
            h, doc, a, back, on = (np.concatenate(x) for x in zip(*got, strict=True))
            rows = []
            for deal, r in dealt((h % U(deals)).astype(np.int64)):
                r = r[np.argsort(h[r], kind="stable")]
                names, number = np.unique(doc[r], return_inverse=True)
                head = freeze([(names, 8)])
                rows.append((deal, len(head).to_bytes(4, "little") + head + freeze([(h[r] >> U(24), 5), (number.astype(U), 4), (a[r].astype(U), 4), (back[r].astype(U), 1), (on[r].astype(U), 1)])))
            yield pd.DataFrame(rows, columns=["deal", "blob"])

    return docs.select("doc_id", "text").mapInPandas(run, "deal int, blob binary")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(doc_id, at): anchors whose gram two ids or more hold; at = place, windows before it, packed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for b in pdf["blob"]:
            n = int.from_bytes(b[:4], "little")
            names = thaw(b[4 : 4 + n], [8])[0][0].view(np.int64)
            h, number, a, back, on = thaw(b[4 + n :], [5, 4, 4, 1, 1])[0]
            got.append((h, names[number.astype(np.int64)], (a << U(16) | back << U(8) | on).view(np.int64)))
        h, doc, at = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(many, np.diff(np.append(first, len(h))))
        return pd.DataFrame({"doc_id": doc[keep], "at": at[keep]})

    return rows.groupBy("deal").applyInPandas(run, "doc_id long, at long")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].., size[0] of them, then start[1].., and so on."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(start) else end


def least_by(keys: list[np.ndarray], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value among rows alike in keys, for each row; and a number for each row's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return (np.minimum.reduceat(value[order], first)[group] if len(first) else value), group


SPANS, CONTEXTS = 0, 1


def context_rows(found: DataFrame, deals: int) -> DataFrame:
    """(deal, kind, blob) of rows (doc_id, th, text, ats): contexts by gram, and spans that are settled within the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ths, ats, rows = ids_of(pdf), pdf["th"].to_numpy(dtype=np.int64), pdf["ats"].tolist(), []
            for start, texts in chunks(pdf["text"].tolist()):
                buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
                size = np.array(list(map(len, texts)))
                begin = np.concatenate(([0], np.cumsum(size)))
                own = [np.asarray(x, dtype=np.int64) for x in ats[start : start + len(texts)]]
                text = np.repeat(np.arange(len(texts)), list(map(len, own)))
                at = np.concatenate(own)
                a, lo, hi = at >> 16, (at >> 16) - (at >> 8 & 255), (at >> 16) - (at & 255)
                ok = hi + LENGTH <= size[text]  # places of another row with the same id may lie outside
                text, a, lo, hi = text[ok], a[ok], lo[ok], hi[ok]
                up, down = powers(len(buf) + 1)
                total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(byte_codes()[buf] * up[: len(buf)])))
                name = lambda s, e, t=total, d=down: mix((t[e] - t[s]) * d[s] + (e - s).astype(U))
                off = begin[text]
                gram, context = name(off + a, off + a + GRAM), name(off + lo, off + hi + LENGTH) ^ (a - lo).astype(U)
                doc, th = ids[start + text], ths[start + text]
                least, _ = least_by([gram, context], doc)
                late = doc > least
                for t in np.unique(text[late]):
                    r = late & (text == t)
                    s, e = merge(lo[r], hi[r] + LENGTH)
                    rows.append((int(start + t) % deals, SPANS, freeze([(np.full(len(s), ids[start + t]), 8), (np.full(len(s), ths[start + t]), 8), (s, 4), (e, 4)])))
                r0 = np.flatnonzero(~late)
                for deal, r in dealt((gram[r0] % U(deals)).astype(np.int64)):
                    r = r0[r]
                    n = hi[r] - lo[r] + LENGTH
                    rows.append((deal, CONTEXTS, freeze([(gram[r], 8), (context[r], 8), (doc[r], 8), (th[r], 8), (lo[r], 4), (hi[r] - lo[r], 1)], buf[ragged(off[r] + lo[r], n)].tobytes())))
            yield pd.DataFrame(rows, columns=["deal", "kind", "blob"])

    return found.select("doc_id", "th", "text", "ats").mapInPandas(run, "deal int, kind int, blob binary")


def deep_shallow(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of LENGTH bytes: (order, leaf of each row). Rows have one leaf exactly if they are equal."""
    n = len(suffixes)
    key = [np.ascontiguousarray(suffixes[:, i : i + 8]).view(">u8").reshape(-1).astype(U) for i in range(0, SHALLOW, 8)]
    order = np.lexsort(key[::-1])  # shallow: multikey quicksort, a key at a time
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[order][1:] != k[order][:-1]
    active = np.arange(n)  # places in the order that belong to groups of two or more, not yet leaves
    while len(active):
        first = np.flatnonzero(new[active])
        size = np.diff(np.append(first, len(active)))
        keep = np.repeat(size > 1, size)
        active = active[keep]
        if not len(active):
            break
        first = np.flatnonzero(new[active])
        size = np.diff(np.append(first, len(active)))
        rows = suffixes[order[active]]
        differs = rows != np.repeat(rows[first], size, axis=0)
        depth = np.where(differs.any(1), differs.argmax(1), LENGTH)
        branch = np.minimum.reduceat(depth, first)  # the trie's skip: all agree up to here
        open_ = np.repeat(branch < LENGTH, size)
        active, rows, at = active[open_], rows[open_], np.repeat(branch, size)[open_]
        if not len(active):
            break
        byte = rows[np.arange(len(rows)), at]
        group = np.cumsum(new[active])
        by = np.lexsort((byte, group))
        order[active] = order[active[by]]
        g, b = group[by], byte[by]
        new[active] = np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])))
    leaf = np.empty(n, dtype=np.int64)
    leaf[order] = np.cumsum(new) - 1
    return order, leaf


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, th, start, stop): bytes of strings that a smaller id holds too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, got, raw = [], [], []
        for kind, b in zip(pdf["kind"], pdf["blob"], strict=True):
            if kind == SPANS:
                d, t, s, e = thaw(b, [8, 8, 4, 4])[0]
                out.append((d.view(np.int64), t.view(np.int64), s.astype(np.int64), e.astype(np.int64)))
            else:
                c, tail = thaw(b, [8, 8, 8, 8, 4, 1])
                got.append(c)
                raw.append(tail)
        if got:
            gram, context, doc, th, lo, more = (np.concatenate(x) for x in zip(*got, strict=True))
            doc, th, lo, more = doc.view(np.int64), th.view(np.int64), lo.astype(np.int64), more.astype(np.int64)
            buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
            size = more + LENGTH
            begin = np.cumsum(size) - size
            least, number = least_by([gram, context], doc)
            late = doc > least
            out.append((doc[late], th[late], lo[late], (lo + size)[late]))
            # One of each context; those alone with their gram are done.
            _, one = np.unique(number, return_index=True)
            _, gram_of = np.unique(gram[one], return_inverse=True)
            one = one[np.bincount(gram_of)[gram_of] > 1]
            if len(one):
                windows = more[one] + 1
                owner = np.repeat(np.arange(len(one)), windows)
                p = ragged(begin[one], windows)
                leaf = np.empty(len(p), dtype=np.int64)
                # Windows of one gram meet; grams are sorted a bounded number of windows at a time.
                for part in portions(gram[one], windows):
                    w = np.flatnonzero(part[owner])
                    leaf[w] = deep_shallow(buf[p[w][:, None] + np.arange(LENGTH)])[1] + (int(w[0]) << 20 if len(w) else 0)
                ids = least[one][owner]
                smallest, _ = least_by([leaf.view(U)], ids)
                hit = ids > smallest
                mask_start = np.cumsum(windows) - windows
                place = np.full(int(number.max()) + 1, -1, dtype=np.int64)
                place[number[one]] = np.arange(len(one))
                mine = np.flatnonzero(~late & (place[number] >= 0))
                k = place[number[mine]]
                each = windows[k]
                w = ragged(mask_start[k], each)
                occ = np.repeat(mine, each)
                s = lo[occ] + w - np.repeat(mask_start[k], each)
                some = hit[w]
                occ, s = occ[some], s[some]
                if len(occ):
                    new = np.concatenate(([True], (occ[1:] != occ[:-1]) | (s[1:] != s[:-1] + 1)))
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(s)) - 1
                    out.append((doc[occ[first]], th[occ[first]], s[first], s[last] + LENGTH))
        if not out:
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("doc_id", "th", "start", "stop")})
        return pd.DataFrame(dict(zip(("doc_id", "th", "start", "stop"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return rows.groupBy("deal").applyInPandas(run, "doc_id long, th long, start long, stop long")


def portions(gram: np.ndarray, windows: np.ndarray, most: int = 400_000) -> Iterator[np.ndarray]:
    """Flags of contexts: grams together, about `most` windows at a time."""
    _, inverse = np.unique(gram, return_inverse=True)
    total = np.cumsum(np.bincount(inverse, weights=windows))
    part = (total // most).astype(np.int64)[inverse]
    for x in np.unique(part):
        yield part == x


def spans_by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans as packed 32-bit starts and ends) for documents that lose bytes."""
    spark = docs.sparkSession
    deals = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    light = docs.select("doc_id", "th", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    copies = cut(light.join(small(firsts.drop("n")), "digest").filter(F.col("doc_id") > F.col("least")).select("doc_id", "th", "n_bytes").distinct(), "copies")
    # Leaving copies out only saves work: what they share with others, the first of them shares too.
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rest = docs.join(F.broadcast(copies.select("doc_id", "th")), ["doc_id", "th"], "left_anti")
    else:
        rest = docs
    shared = shared_anchors(anchor_rows(rest, deals)).groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    found = repeated_spans(context_rows(rest.join(shared, "doc_id"), deals))
    whole = copies.filter(F.col("n_bytes") >= LENGTH).select("doc_id", "th", F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("stop"))
    spans = found.unionByName(whole).groupBy("doc_id", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [b"".join(x.astype("<i4").tobytes() for x in merge(np.asarray(s, dtype=np.int64), np.asarray(e, dtype=np.int64))) for s, e in zip(pdf["starts"], pdf["stops"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "spans": packed})

    return cut(spans.mapInPandas(run, "doc_id long, th long, spans binary"), "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text bytes kept, and counts of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NONE))).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = spans_by_document(rows)
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0)).alias("b")).first()
    side = F.broadcast(spans) if size["n"] <= BROADCAST_ROWS and size["b"] + 16 * size["n"] <= BROADCAST_BYTES else spans

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["spans"], strict=True):
                b = text.encode("utf-8", "surrogatepass")
                at = np.frombuffer(spans, dtype="<i4").reshape(2, -1).T.tolist() if spans is not None else []
                kept, done = [], 0
                for s, e in at:
                    kept.append(b[done:s])
                    done = e
                rest = b"".join([*kept, b[done:]])
                out.append((None if doc == NONE else doc, len(b), len(b) - len(rest), len(at), hashlib.sha256(rest).hexdigest(), rest))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return rows.join(side, ["doc_id", "th"], "left").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents")).drop("kept")


SQL = {
    "op3_suffixes": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS i, x FROM d),
s AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS h FROM p),
m AS (SELECT h, min(doc_id) AS f FROM s GROUP BY h),
r AS (SELECT s.doc_id, s.i FROM s JOIN m USING (h) WHERE s.doc_id > m.f),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS n FROM r),
k AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
z AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
e AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM z),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""
}
