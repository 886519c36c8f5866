"""Path search, and features of single paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path
from chronofeat.plans import batch
from chronofeat.plans.hops import hops

__all__ = ["hops", "run", "search"]


def search(catalog: Catalog, most: int = 3) -> list[Path]:
    """All paths from main of at most `most` hops that visit no table twice; then each with one hop of a self relation more."""
    own = [r for r in catalog.relations if r.src == r.dst]
    steps = [r for r in catalog.relations if r.src != r.dst]
    steps += [r.inverse for r in steps]
    found, edge = [Path(catalog.main)], [Path(catalog.main)]
    for _ in range(most):
        edge = [p.then(r) for p in edge for r in steps if r.src == p.end and r.dst not in {p.start, *(x.dst for x in p.relations)}]
        found += edge
    return found + [p.then(r) for p in found for r in own if r.src == p.end]


def run(catalog: Catalog, path: Path, value: str, first: str, later: str, name: str = "feature", times: dict[str, str] | None = None, inherit_time: bool = True) -> DataFrame:
    """main's rows with one feature: the deepest to-many hop aggregates by `first`, those above it by `later`; to-one hops look up. See batch.run()."""
    piece = batch.Piece(name, path, F.col(value), first, later)
    kept = [c for c in catalog.tables[path.start].frame.columns if c != name]
    here = Catalog(path.start, catalog.tables, catalog.relations, catalog.target, catalog.modes)
    return batch.run(here, [piece], kept, times, inherit_time, catalog.modes).select(*kept, name)
