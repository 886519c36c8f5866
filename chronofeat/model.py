"""Tables, relations and paths."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame


class RelationType(Enum):
    """(source id is unique, destination id is unique)."""

    ONE_TO_ONE = (True, True)
    ONE_TO_MANY = (True, False)
    MANY_TO_ONE = (False, True)
    MANY_TO_MANY = (False, False)

    @property
    def to_one(self) -> bool:
        return self.value[1]

    @property
    def inverse(self) -> RelationType:
        return RelationType(self.value[::-1])


@dataclass(frozen=True)
class Relation:
    src: str
    src_id: str
    dst: str
    dst_id: str
    type: RelationType

    @property
    def inverse(self) -> Relation:
        return Relation(self.dst, self.dst_id, self.src, self.src_id, self.type.inverse)


@dataclass(frozen=True)
class Path:
    """A chain of relations that starts at the main table."""

    start: str
    relations: tuple[Relation, ...] = ()

    @property
    def end(self) -> str:
        return self.relations[-1].dst if self.relations else self.start

    @property
    def to_many(self) -> int:
        return sum(not r.type.to_one for r in self.relations)

    @property
    def to_one(self) -> int:
        return sum(r.type.to_one for r in self.relations)

    def then(self, r: Relation) -> Path:
        if r.src != self.end:
            raise ValueError(f"{r.src} does not follow {self.end}")
        return Path(self.start, (*self.relations, r))

    @property
    def name(self) -> str:
        return ".".join([self.start, *(f"{r.dst}_{r.dst_id}" for r in self.relations)])


@dataclass
class Table:
    """A frame with its row key, time column and roles of columns (`n` number, `c` category, `t` time, `m` bag of words). known: statistics that rules have computed."""

    frame: DataFrame
    row: str
    time: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    known: dict = field(default_factory=dict, compare=False, repr=False)


@dataclass
class Catalog:
    """target: the main table's column of 0 and 1, null where it is unknown. modes: aggregates of the user's own, from a column to one expression, by name."""

    main: str
    tables: dict[str, Table]
    relations: list[Relation]
    target: str | None = None
    modes: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def replaced(self, **frames: DataFrame) -> Catalog:
        """The catalog with other frames for some tables."""
        tables = {n: Table(frames.get(n, t.frame), t.row, t.time, t.roles) for n, t in self.tables.items()}
        return Catalog(self.main, tables, self.relations, self.target, self.modes)
