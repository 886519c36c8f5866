"""Feature candidates of a catalog: which aggregate of which column along which path, cheapest first; and their batched run.

A rule sees a path and its last table and offers features. All features are broken into pieces, values that travel along paths,
which run together (`batch`), and are put together again at main.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path, Table
from chronofeat.operators.aggregates import COUNTED, ORDERED
from chronofeat.plans import batch, paths
from chronofeat.plans.dependencies import Dependency, one_in_substance


@dataclass(frozen=True)
class Feature:
    """kind, path and column say what is computed; `detail` is what else a kind needs, such as a value or a second column."""

    kind: str
    path: Path
    column: str | None
    first: str
    later: str
    cost: float
    detail: tuple = ()

    @property
    def name(self) -> str:
        return "__".join([self.kind, self.path.name.replace(".", "_"), self.column or "rows", *map(str, self.detail)])


#: kind: mode of the deepest to-many hop, mode above it, roles of columns.
KINDS: dict[str, tuple[str, str, str]] = {
    "count": ("sum", "sum", ""),
    "duplicates": ("duplicates", "max", "c"),
    "last": ("last", "last", "nct"),
    "max": ("max", "max", "nt"),
    "min": ("min", "min", "nt"),
    "mean": ("mean", "mean", "n"),
    "mean_variance": ("variance", "mean", "n"),
    "sum_variance": ("variance", "sum", "n"),
    "median": ("mean", "median", "n"),
    "mode": ("mode", "mode", "c"),
    "nunique": ("nunique", "max", "c"),
    "sum": ("rolling_sum10", "max", "n"),
}


def cost(path: Path, *modes: str) -> float:
    """Exchanges that a feature needs: one a hop, and a sort more for modes that depend on order or on distinct values."""
    sorts = sum(m in ORDERED or m in COUNTED or m in ("median", "mode_ratio") for m in modes)
    return len(path.relations) + sorts / 2


Rule = Callable[[Path, Table], list[Feature]]
RULES: list[Rule] = []


@dataclass(frozen=True)
class Built:
    """How a feature comes about: pieces, the expression over their names and columns of main that makes the feature, and those columns."""

    feature: Feature
    pieces: list[batch.Piece]
    value: Column
    needs: tuple[str, ...] = ()


Builder = Callable[[Catalog, list[Feature]], list[Built]]
#: Kinds that are no plain aggregate or lookup. A builder sees all features of its kinds at once.
BUILDERS: dict[str, Builder] = {}
#: Modes of pieces that are none of the user's.
SPECIAL: dict[str, Callable[[Column], Column]] = {}


def rule(f: Rule) -> Rule:
    """Register a rule; users add their own the same way."""
    RULES.append(f)
    return f


def builder(*kinds: str):
    """Register how features of these kinds are built."""

    def add(f):
        BUILDERS.update(dict.fromkeys(kinds, f))
        return f

    return add


@rule
def aggregates(path: Path, table: Table) -> list[Feature]:
    if not path.to_many:
        return []
    out = []
    for kind, (first, later, roles) in KINDS.items():
        columns = [None] if not roles else [c for c, r in table.roles.items() if r in roles]
        out += [Feature(kind, path, c, first, later, cost(path, first, *([later] if path.to_many > 1 else []))) for c in columns]
    return out


@rule
def identify(path: Path, table: Table) -> list[Feature]:
    """Columns at the end of to-one paths are looked up."""
    if not path.relations or path.to_many:
        return []
    return [Feature("identify", path, c, "last", "last", cost(path)) for c, r in table.roles.items() if r in "nct"]


def candidates(catalog: Catalog, most_hops: int = 3, most: int | None = None, depends: set[Dependency] | None = None) -> list[Feature]:
    """Features of all paths, cheapest first; at most so many. depends: what keys determine (`dependencies.known`); without it relations are what they are declared to be.

    Columns that a to-many path determines are looked up along it, and neither aggregated nor counted by value.
    """
    found = [f for p in paths.search(catalog, most_hops) for r in RULES for f in r(p, catalog.tables[p.end])]
    if depends is not None:
        one = lambda f: f.column is not None and f.path.to_many and one_in_substance(f.path, f.column, depends)
        found = [f for f in found if not ((f.kind in KINDS or f.kind.startswith("one_hot")) and one(f))]
        looked_up = [Feature("identify", p, c, "last", "last", cost(p)) for p in paths.search(catalog, most_hops) if p.to_many for c, r in catalog.tables[p.end].roles.items() if r in "nct"]
        found += [f for f in looked_up if one(f)]
    return sorted(found, key=lambda f: (f.cost, f.name))[:most]


def plain(catalog: Catalog, features: list[Feature]) -> list[Built]:
    """Aggregates of columns, or of rows, and lookups."""
    return [Built(f, [batch.Piece(f.name, f.path, F.col(f.column) if f.column else F.lit(1), f.first, f.later)], F.col(f.name)) for f in features]


def build(catalog: Catalog, features: list[Feature]) -> DataFrame:
    """main's row key with a column for each feature. Every hop of the tree of their paths runs once for all that comes through it."""
    main, made = catalog.tables[catalog.main], []
    for b in dict.fromkeys(BUILDERS.get(f.kind, plain) for f in features):
        made += b(catalog, [f for f in features if BUILDERS.get(f.kind, plain) is b])
    pieces = [p for m in made for p in m.pieces]
    needs = list(dict.fromkeys(c for m in made for c in m.needs))
    rows = batch.run(catalog, pieces, needs, own={**catalog.modes, **SPECIAL})
    value = {m.feature: m.value for m in made}
    return rows.select(main.row, *[value[f].alias(f.name) for f in features])
