"""N-gram Jaccard join by a token-group matrix.

1. Equal shingle sets fold into one unit (a set and its 64-bit name).
2. Similar units are gathered into families. If two sets of one size class reach the threshold, they differ in
   at most d tokens; with tokens dealt to more than d parts by hash, some parts of both are the same, and
   each set keeps the d+1 fullest of its own, one of which is a common one. Units that hold an equal part, directly or
   through others, are a family. What a batch or a deal connects leaves it as stars: one row for each unit, not one for
   each pair, so that a part that a third of all documents hold stays a short list.
3. A family is cut into blocks of bounded size, and a block into groups of units with like least tokens; a group keeps
   the union of its members' tokens. The overlap of a query with the union bounds that with any member, and only groups
   whose bound reaches the threshold are opened: there, the overlap with each member is counted. What a block links
   leaves it as stars again.
4. Most families are one block, which is searched against itself. In the others, each block is searched against the
   first one too; units that are then outside their family's largest component are searched against all of its blocks.
   Units of that component need no search among themselves: they are connected.
5. Components of all links.

A family of m units of which r stay outside the largest component costs m*r/BLOCK^2 pairs of blocks.

Defined cases: a text of fewer words than a shingle has its whole word sequence as
one; null, empty and wordless texts have an empty set, which links with nothing; a
null id takes part, and a component's id is its smallest non-null one; rows that
repeat an id are judged each by its text; an empty table gives an empty result; a very long text is a block of its own;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read, small
from chronofeat.llm.components import components
from chronofeat.llm.deals import dealt, freeze, thaw
from chronofeat.llm.textnum import U, chunks, mix, pack, shingle_sets, unpack

#: Units to a group and to a block of the matrix, tokens to a block, tokens to a slice of the matrix.
GROUP, BLOCK, BLOCK_TOKENS, SLICE = 64, 1024, 1 << 17, 4096
#: Size classes grow by this factor; parts to each one that is needed; signatures to a deal.
CLASS, SPARE, DEAL = 1.5, 1.25, 1 << 19
#: The low bits of a signature and of a node name its size class.
SLOTS = 64


def class_bounds(most: int = 1 << 31) -> np.ndarray:
    """Least size of each size class."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS)))
    return np.array(out)


def parts_of(bounds: np.ndarray, percent: int) -> np.ndarray:
    """By class, one more than the tokens in which two linked sets of sizes up to the class's largest can differ: (a+b)(1-t)/(1+t)."""
    return 2 * (bounds[1:] - 1) * (100 - percent) // (100 + percent) + 1


def set_names(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(g ^ U(0xA0761D6478BD642F)))))
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U)).view(np.int64)


def part_hashes(g: np.ndarray, first: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, its size class, parts of it, hash and tokens of every part): sets in their own class, then in the next one where a set of that class can be near enough."""
    bounds = class_bounds()
    parts = np.ceil(parts_of(bounds, percent) * SPARE).astype(np.int64)
    size = np.diff(first)
    own = np.searchsorted(bounds, size, side="right") - 1
    for up in (0, 1):
        chosen = np.flatnonzero((size > 0) if not up else (size > 0) & (100 * size >= percent * bounds[own + 1]))
        slot = own[chosen] + up
        n = parts[slot]
        start = np.concatenate(([0], np.cumsum(n)))
        length = size[chosen]
        stop = np.cumsum(length)
        token = g[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first[chosen] - (stop - length), length)]
        salt = np.repeat(mix(slot.astype(U) + U(0x51ED270B)), length)
        at = np.repeat(start[:-1], length) + (mix(token ^ salt) % np.repeat(n, length).astype(U)).astype(np.int64)
        held = np.zeros(start[-1], dtype=U)
        np.add.at(held, at, mix(token ^ U(0xE7037ED1A0B428DB)))
        yield chosen, slot, n, held, np.bincount(at, minlength=start[-1])


def signatures(g: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the parts by which sets are found.

    A set of a tokens differs from any that it links with in d parts at most, so of n parts n - d agree at least. It
    leaves out the n - d - 1 with the fewest tokens (equal ones in the order of their signatures), which say least:
    the last agreeing part in that order is kept by both sets.
    """
    bounds, out = class_bounds(), []
    for chosen, slot, n, held, count in part_hashes(g, first, percent):
        number = np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n)
        classes = np.repeat(slot.astype(U), n)
        sig = mix(mix(held) ^ mix(number.astype(U) * U(SLOTS) + classes))
        size = np.diff(first)[chosen]
        differ = most_differing(size, np.minimum(100 * size // percent, bounds[slot + 1] - 1), percent)
        at = np.repeat(np.arange(len(chosen)), n)
        order = np.lexsort((sig, count, at))
        kept = np.sort(order[number >= np.repeat(n - differ - 1, n)])
        out.append(((sig & ~U(SLOTS - 1) | classes).view(np.int64)[kept], chosen[at[kept]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def each_sets(pdf: pd.DataFrame, n: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    for start, texts in chunks(pdf["text"].tolist()):
        g, first = shingle_sets(texts, n)
        yield pdf.iloc[start : start + len(texts)], g, first, set_names(g, first)


def unit_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, unit of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, _, first, name in each_sets(pdf, n):
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(dtype=object), "n_shingles": np.diff(first), "unit": name})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, unit long")


def batch_signatures(pdf: pd.DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, unit) of the batch, sorted, each pair once."""
    got = [(np.empty(0, dtype=np.int64),) * 2]
    for _, g, first, name in each_sets(pdf.drop_duplicates("text"), n):
        sig, at = signatures(g, first, percent)
        got.append((sig, name[at]))
    return by_signature(*(np.concatenate(x) for x in zip(*got, strict=True)))


def by_signature(sig: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((unit, sig))
    sig, unit = sig[order], unit[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (unit[1:] != unit[:-1])
    return sig[keep], unit[keep]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node connected with it) of all nodes of the links but the smallest ones."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    roots = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def holders(sig: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stars of the nodes (a unit in a size class) that hold an equal signature, and whether a row is its signature's first. Rows are sorted."""
    first = np.ones(len(sig), dtype=bool)
    first[1:] = sig[1:] != sig[:-1]
    node = (unit & ~(SLOTS - 1)) | (sig & (SLOTS - 1))
    return *stars(node[~first], node[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]), first


def alike(docs: DataFrame, n: int, percent: int, deals: int) -> DataFrame:
    """(u, v): nodes that an equal part connects, as stars of batches and deals."""

    def deal_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig, unit = batch_signatures(pdf, n, percent)
            u, v, first = holders(sig, unit)
            sig, unit = sig[first], unit[first]
            rows = [(deal, False, freeze([(sig[r], 8), (unit[r], 8)])) for deal, r in dealt((mix(sig.view(U)) % U(deals)).astype(np.int64))]
            rows += [(deal, True, freeze([(u[r], 8), (v[r], 8)])) for deal, r in dealt((mix(v.view(U)) % U(deals)).astype(np.int64))]
            yield pd.DataFrame(rows, columns=["deal", "done", "blob"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        got = {done: [np.empty((2, 0), dtype=np.int64)] for done in (False, True)}
        for done, blob in zip(pdf["done"], pdf["blob"], strict=True):
            got[done].append(np.stack([x.view(np.int64) for x in thaw(blob, [8, 8])[0]]))
        links, signed = np.concatenate(got[True], axis=1), np.concatenate(got[False], axis=1)
        u, v, _ = holders(*by_signature(*signed))
        u, v = stars(np.concatenate((u, links[0])), np.concatenate((v, links[1])))
        return pd.DataFrame({"u": u, "v": v})

    dealt_out = docs.select("text").mapInPandas(deal_out, "deal int, done boolean, blob binary")
    return dealt_out.groupBy("deal").applyInPandas(gather, "u long, v long")


def token_sets(docs: DataFrame, n: int) -> DataFrame:
    """(unit, tokens) of every row; tokens are sorted 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g, first, name in each_sets(pdf, n):
                yield pd.DataFrame({"unit": name, "tokens": [pack(g[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]})

    return docs.mapInPandas(run, "unit long, tokens binary")


def most_differing(a, b, percent: int):
    """Tokens in which linked sets of sizes a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


class Block:
    """Units of a block with their tokens, in the order of their least tokens, so that groups hold like ones."""

    def __init__(self, units: np.ndarray, size: np.ndarray, tokens: np.ndarray):
        self.units, self.size, self.tokens = units, size, tokens

    @classmethod
    def of(cls, rows: dict[int, bytes]) -> Block:
        """rows: tokens by unit."""
        order = sorted(rows, key=lambda u: unpack(rows[u])[:2].tolist())
        return cls(np.array(order, dtype=np.int64), np.array([len(rows[u]) // 8 for u in order], dtype=np.int64), unpack(b"".join(rows[u] for u in order)))

    def packed(self) -> bytes:
        return b"".join(x.astype("<i8", copy=False).tobytes() for x in (np.array([len(self.units)]), self.units, self.size)) + self.tokens.tobytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> Block:
        n = int(np.frombuffer(blob, dtype="<i8", count=1)[0])
        head = np.frombuffer(blob, dtype="<i8", offset=8, count=2 * n)
        return cls(head[:n], head[n:], np.frombuffer(blob, dtype="<u8", offset=8 + 16 * n))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        stop = np.cumsum(self.size)
        for u, a, b in zip(self.units.tolist(), stop - self.size, stop, strict=True):
            yield u, self.tokens[a:b].tobytes()


def matrix_slices(q: Block, g: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """0/1 matrices of the units of q and of g by the tokens that both hold, a slice of tokens at a time."""
    if q is g:
        shared, count = np.unique(q.tokens, return_counts=True)
        shared = shared[count > 1]
    else:
        shared = np.intersect1d(q.tokens, g.tokens)

    def cells(b: Block) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, b.tokens)
        held = shared[np.minimum(at, len(shared) - 1)] == b.tokens
        order = np.argsort(at[held], kind="stable")
        return np.repeat(np.arange(len(b.units)), b.size)[held][order], at[held][order]

    if not len(shared):
        return
    sides = [cells(q)] if q is g else [cells(q), cells(g)]
    for low in range(0, len(shared), SLICE):
        width, out = min(SLICE, len(shared) - low), []
        for b, (row, at) in zip((q, g), sides, strict=False):
            x = np.zeros((len(b.units), width), dtype=np.float32)
            a, z = np.searchsorted(at, (low, low + width))
            x[row[a:z], at[a:z] - low] = 1
            out.append(x)
        yield out[0], out[-1]


def opened(q: Block, g: Block, percent: int) -> np.ndarray:
    """Which units of q and g link. Groups of g are opened by the overlap of a query with their union."""
    edges = np.arange(0, len(g.units), GROUP)
    slices = list(matrix_slices(q, g)) if len(q.tokens) + len(g.tokens) <= BLOCK_TOKENS else None
    again = lambda: slices if slices is not None else matrix_slices(q, g)
    bound = np.zeros((len(q.units), len(edges)))
    for asked, held in again():
        bound += asked @ np.maximum.reduceat(held, edges, axis=0).T
    least = np.minimum.reduceat(g.size, edges)
    may = (100 + percent) * bound >= percent * (q.size[:, None] + least[None])
    both = np.zeros((len(q.units), len(g.units)))
    for asked, held in again():
        for at in np.flatnonzero(may.any(0)):
            i, j = np.flatnonzero(may[:, at]), slice(edges[at], edges[at] + GROUP)
            both[i, j] += asked[i] @ held[j].T
    return (both > 0) & ((100 + percent) * both >= percent * (q.size[:, None] + g.size[None]))


def block_links(q: Block, g: Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the units of q with those of g that connect all that such links connect: at most one for each unit of either."""
    link, label, u, v = opened(q, g, percent), np.arange(len(g.units)), [], []
    for i in np.flatnonzero(link.any(1)):
        j = np.flatnonzero(link[i])
        labels, first = np.unique(label[j], return_index=True)
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
        u += [q.units[i]] * len(labels)
        v += g.units[j[first]].tolist()
    u, v = np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)
    return u[u != v], v[u != v]


def families_of(edges: DataFrame, percent: int) -> DataFrame:
    """(mask, family, block, blocks): by node its unit's high bits, its family, a block there and how many there are."""
    named = components(edges)
    named = cut(named.union(named.select("root", "root").distinct()), "families")
    slot = F.col("root").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    hold = F.array(*[F.lit(int(max(1, min(BLOCK, BLOCK_TOKENS // b)))) for b in class_bounds()[:-1]])
    count = named.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / hold[slot]).cast("int"))
    joined = named.join(small(count.filter("blocks > 1").select(F.col("root").alias("large"), "blocks")), F.col("root") == F.col("large"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    return joined.select(F.col("node").bitwiseAND(F.lit(-SLOTS)).alias("mask"), F.col("root").alias("family"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))


def in_blocks(placed: DataFrame, percent: int, search: bool) -> DataFrame:
    """(u, v, family, block, blocks, blob) of rows (family, block, blocks, unit, tokens): links within blocks if they are to be searched, and the blocks of families of several or all blocks else."""
    columns = "u long, v long, family long, block int, blocks int, blob binary"

    def done(key: tuple, rows: dict) -> pd.DataFrame:
        b, out = Block.of(rows), []
        if search and len(rows) > 1:
            u, v = block_links(b, b, percent)
            out.append(pd.DataFrame({"u": u, "v": v, "family": key[0], "block": key[1], "blocks": key[2], "blob": None}))
        if key[2] > 1 or not search:
            out.append(pd.DataFrame({"u": [0], "v": [0], "family": key[0], "block": key[1], "blocks": key[2], "blob": [b.packed()]}))
        return pd.concat(out) if out else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, {}
        for pdf in batches:
            for *key, unit, tokens in zip(pdf["family"].tolist(), pdf["block"].tolist(), pdf["blocks"].tolist(), pdf["unit"].tolist(), pdf["tokens"], strict=True):
                if key != now:
                    if now and (out := done(now, rows)) is not None:
                        yield out
                    now, rows = key, {}
                rows[unit] = tokens
        if now and (out := done(now, rows)) is not None:
            yield out

    return placed.repartition("family", "block").sortWithinPartitions("family", "block").select("family", "block", "blocks", "unit", "tokens").mapInPandas(run, columns)


def between(queries: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of query blocks with blocks; both (family, q, g, blob)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                u, v = block_links(Block.unpacked(a), Block.unpacked(b), percent)
                yield pd.DataFrame({"u": u, "v": v})

    key = ["family", "q", "g"]
    return queries.select(*key, F.col("blob").alias("a")).join(groups.select(*key, F.col("blob").alias("b")), key).select("a", "b").mapInPandas(run, "u long, v long")


def unit_tokens(blocks: DataFrame) -> DataFrame:
    """(family, unit, tokens) of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for family, blob in zip(pdf["family"], pdf["blob"], strict=True):
                unit, tokens = zip(*Block.unpacked(blob).rows(), strict=True)
                yield pd.DataFrame({"family": family, "unit": unit, "tokens": tokens})

    return blocks.select("family", "blob").mapInPandas(run, "family long, unit long, tokens binary")


def large_families(blocks: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """links and those between the blocks of families of several."""
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    first = blocks.filter("block = 0").withColumn("q", F.lit(0)).withColumn("g", each(F.col("blocks"))).filter("g > 0")
    links = cut(links.union(between(first, blocks.withColumn("q", F.lit(0)).withColumn("g", F.col("block")), percent)), "glued")
    roots = components(links)
    units = cut(unit_tokens(blocks).select("family", "unit"), "large")
    rooted = cut(units.join(small(roots), units["unit"] == roots["node"], "left").select("family", "unit", F.coalesce("root", "unit").alias("root")), "rooted")
    main = rooted.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("m")).select("family", F.col("m.root").alias("main"))
    rest = cut(rooted.join(small(main), "family").filter("root <> main").select("family", "unit"), "rest")
    # As many blocks as all units would need keep tokens to a block bounded; they are dealt by share.
    held = blocks.select("family", F.col("blocks").alias("all")).distinct().join(units.groupBy("family").agg(F.count(F.lit(1)).alias("units")), "family")
    count = rest.groupBy("family").agg(F.count(F.lit(1)).alias("n")).join(held, "family").select("family", F.ceil(F.col("n") * F.col("all") / F.col("units")).cast("int").alias("blocks"))
    count = cut(count, "rests")
    placed = rest.join(small(count), "family").withColumn("block", F.pmod(F.xxhash64("unit", F.lit(1)), F.col("blocks")).cast("int"))
    asked = cut(in_blocks(unit_tokens(blocks).join(small(placed), ["family", "unit"]), percent, False), "asked")
    queries = asked.withColumn("q", F.col("block")).drop("blocks").join(small(held.select("family", "all")), "family").withColumn("g", each(F.col("all")))
    groups = blocks.withColumn("g", F.col("block")).drop("blocks").join(small(count), "family").withColumn("q", each(F.col("blocks")))
    return cut(links.union(between(queries, groups, percent)), "links")


def texts_of(docs: DataFrame, rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Rows of docs that hold the units of these high bits (and others with their ids)."""
    held = rows.filter("n_shingles > 0").withColumn("mask", F.col("unit").bitwiseAND(F.lit(-SLOTS))).join(small(masks), "mask", "left_semi")
    chosen = held.groupBy("unit").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("d")).select(F.col("d.doc_id").alias("chosen_id")).distinct()
    return docs.join(small(cut(chosen, "chosen")), F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi")


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, unit) of every row, and (unit, component_id) of every unit with a set. n words to a shingle; links from percent / 100 on."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = cut(unit_rows(docs, n), "units")
    tokens = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    deals = 1 + tokens * 4 * (100 - percent) // (100 + percent) // DEAL
    placed = cut(families_of(alike(docs, n, percent, deals), percent), "placed")
    sets = token_sets(texts_of(docs, rows, placed.select("mask").distinct()), n).withColumn("mask", F.col("unit").bitwiseAND(F.lit(-SLOTS)))
    found = cut(in_blocks(sets.join(small(placed), "mask"), percent, True), "blocks")
    links, blocks = found.filter("blob is null").select("u", "v"), found.filter("blob is not null").drop("u", "v")
    if blocks.limit(1).count():
        links = large_families(blocks, links, percent)
    final = components(links)
    least = rows.filter("n_shingles > 0").groupBy("unit").agg(F.min("doc_id").alias("least"))
    joined = least.join(final, least["unit"] == final["node"], "left").select("unit", "least", F.coalesce("root", "unit").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, joined.join(ids, "root").select("unit", "component_id")


def components_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    rows, ids = similar_groups(docs, n, percent)
    return rows.join(ids, "unit", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(read(spark, sf_dir, "documents"), 3, 90)


SQL = {
    "op5_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
             ELSE list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 90 * (u.n + v.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
}
