"""Many values along many paths at once.

Paths that begin alike are a tree of their prefixes, whose nodes are tables. A node's frame takes the values of its own columns, then, by one hop for
each table below it, everything that comes up from there: all columns and modes of a hop share its exchange and sort. So the number of
exchanges follows from the hops of the tree, not from the number of values.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path, Relation, Table
from chronofeat.operators import temporal
from chronofeat.operators.aggregates import NO_OWN, Own
from chronofeat.plans.hops import hops


#: Rows of a table, and keys that are asked for, that a broadcast may hold.
FEW = 1 << 14


def large(table: Table) -> bool:
    """Whether the table has more rows than a broadcast may hold; they are counted once."""
    if "large" not in table.known:
        table.known["large"] = table.frame.limit(FEW + 1).count() > FEW
    return table.known["large"]


def asked(lower: DataFrame, id: str, above: Table, at: str) -> DataFrame:
    """Of the rows below a hop those whose key occurs above it, where these keys are few: no other is seen."""
    keys = above.frame.select(F.col(at).alias("_asked")).filter("_asked IS NOT NULL").distinct()
    known = above.known.setdefault("asked", {})
    if at not in known:
        known[at] = keys.limit(FEW + 1).count()
    return lower.join(F.broadcast(keys), F.col(id) == F.col("_asked"), "left_semi") if known[at] <= FEW else lower


@dataclass(frozen=True)
class Piece:
    """A value of a path's last table, brought to main: the deepest to-many hop aggregates by `first`, those above it by `later`; to-one hops look up. frame: read instead of the table."""

    name: str
    path: Path
    value: Column
    first: str
    later: str
    frame: DataFrame | None = None


#: A node: relations that lead to it, those its time is inherited along (None: its own time or none), and the frame read instead of its table.
Key = tuple[tuple[Relation, ...], tuple[Relation, ...] | None, int | None]


@dataclass
class Node:
    pieces: list[Piece] = field(default_factory=list)
    #: By relations of the hop, its kind and the key of the node below: the pieces that come up, with their modes.
    below: dict[tuple[tuple[Relation, ...], bool, bool, Key], list[tuple[Piece, str | None]]] = field(default_factory=dict)


class Tree:
    """times: time column by table, instead of the catalog's."""

    def __init__(self, catalog: Catalog, pieces: list[Piece], times: Mapping[str, str | None] | None, inherit_time: bool):
        self.catalog, self.inherit = catalog, inherit_time
        self.times = {n: t.time for n, t in catalog.tables.items()} if times is None else {n: times.get(n, t.time) for n, t in catalog.tables.items()}
        self.nodes: dict[Key, Node] = {}
        self.frames: dict[int, DataFrame] = {}
        self.root: Key = ((), None, None)
        self.nodes[self.root] = Node()
        for p in pieces:
            self.add(p)

    def table(self, relations: tuple[Relation, ...]) -> str:
        return relations[-1].dst if relations else self.catalog.main

    def add(self, piece: Piece) -> None:
        r = piece.path.relations
        names = [piece.path.start, *(x.dst for x in r)]
        timed = [self.times[n] is not None for n in names]
        ways: list[tuple[Relation, ...] | None] = [None] * len(names)
        for i in range(len(r) - 1, 0, -1) if self.inherit else ():
            if not timed[i] and timed[i + 1] and r[i].type.to_one:
                timed[i], ways[i] = True, (r[i], *(ways[i + 1] or ()))
        own = None
        if piece.frame is not None:
            own = id(piece.frame)
            self.frames[own] = piece.frame
        key: Key = (r, ways[-1], own)
        self.nodes.setdefault(key, Node()).pieces.append(piece)
        done = False
        for hop in hops([x.type.to_one for x in r], timed):
            mode = (piece.later if done else piece.first) if hop.many else None
            done = done or hop.many
            above: Key = (r[: hop.src], ways[hop.src], None)
            edge = (r[hop.src : hop.dst], hop.timed, hop.many, key)
            self.nodes.setdefault(above, Node()).below.setdefault(edge, []).append((piece, mode))
            key = above

    def timed(self, frame: DataFrame, key: Key) -> tuple[DataFrame, str | None]:
        """The frame with the node's time, and its column."""
        relations, way, _ = key
        if way is None:
            return frame, self.times[self.table(relations)]
        beyond, time = self.timed(self.catalog.tables[way[0].dst].frame, ((*relations, way[0]), way[1:] or None, None))
        return temporal.inherit_time(frame, beyond, (way[0].src_id, way[0].dst_id), time, "_inherited", large(self.catalog.tables[way[0].dst])), "_inherited"

    def frame(self, key: Key, keep: list[str], own: Own) -> tuple[DataFrame, str | None]:
        """The node's rows with the columns to keep, its time and all values of it and below, by the pieces' names."""
        relations, _, replaced = key
        node, table = self.nodes[key], self.catalog.tables[self.table(relations)]
        rows, time = self.timed(self.frames[replaced] if replaced else table.frame, key)
        ids = [relations[-1].dst_id] if relations else []
        ids += [hop[0].src_id for hop, *_ in node.below]
        held, up = list(dict.fromkeys([*keep, table.row, *([time] if time else []), *ids])), []
        # Lookups run over the table's own columns, before pieces make many of them; then hops along time, which take all columns of a row with them, and what is aggregated joins last.
        hops_in_turn = sorted(node.below.items(), key=lambda h: (h[0][1] or h[0][2], not h[0][1]))
        ahead = sum(not (edge[1] or edge[2]) for edge in node.below)
        for i, ((hop, is_timed, many, below), pieces) in enumerate(hops_in_turn):
            if i == ahead:
                rows = rows.select(*held, *up, *[p.value.alias(p.name) for p in node.pieces])
            end = self.catalog.tables[self.table(below[0])]
            lower, lower_time = self.frame(below, [], own)
            if is_timed and many and len(hop) == 1 and (self.table(below[0]), hop[0].dst_id) != (self.table(relations), hop[0].src_id):
                lower = asked(lower, hop[0].dst_id, table, hop[0].src_id)
            src, at = rows, hop[0].src_id
            if len(hop) > 1:
                middle = [(self.catalog.tables[x.dst].frame, x.dst_id, y.src_id) for x, y in zip(hop[:-1], hop[1:], strict=True)]
                src, at = temporal.squash(rows, middle, at, "_end"), "_end"
            ids, order = (at, hop[-1].dst_id), [end.row]
            wanted, columns = [(p.name, p.name, m) for p, m in pieces], [(p.name, p.name) for p, _ in pieces]
            if is_timed and many:
                out = temporal.asof_aggregate(src, lower, ids, (time, lower_time), order, wanted, own)
            elif is_timed:
                out = temporal.asof_lookup(src, lower, ids, (time, lower_time), order, columns)
            elif many:
                out = temporal.aggregate(src, lower, ids, wanted, order, own, large(end))
            else:
                out = temporal.lookup(src, lower, ids, columns, order, large(end))
            rows, up = out.drop("_end"), [*up, *[p.name for p, _ in pieces]]
        if ahead == len(node.below):
            rows = rows.select(*held, *up, *[p.value.alias(p.name) for p in node.pieces])
        return rows, time


def run(catalog: Catalog, pieces: list[Piece], keep: list[str] | None = None, times: Mapping[str, str | None] | None = None, inherit_time: bool = True, own: Own = NO_OWN) -> DataFrame:
    """main's row key, and columns to keep, with a column for each piece.

    times: time column by table (of its frame); tables without one are untimed. With inherit_time, an untimed table takes the
    time of the row that its to-one relation leads to. own: modes of the user's.
    """
    row, named = catalog.tables[catalog.main].row, pieces
    pieces = [replace(p, name=f"_p{i}") for i, p in enumerate(pieces)]  # names that no table has
    beside = [p for p in pieces if p.frame is not None and not p.path.relations]  # main's own rows, read from another frame
    tree = Tree(catalog, [p for p in pieces if p.frame is None or p.path.relations], times, inherit_time)
    rows, _ = tree.frame(tree.root, keep or [], own)
    for frame in {id(p.frame): p.frame for p in beside}.values():
        side = frame.select(row, *[p.value.alias(p.name) for p in beside if p.frame is frame])
        rows = rows.join(side.hint("merge") if large(catalog.tables[catalog.main]) else side, row, "left")
    return rows.select(*dict.fromkeys([*(keep or []), row]), *[F.col(p.name).alias(n.name) for p, n in zip(pieces, named, strict=True)])

