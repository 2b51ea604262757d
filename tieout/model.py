"""Driver-side descriptions: a side of a comparison, a relationship, a star schema, a measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Side:
    """One result set: its rows, when it was read, and whether the read was cut short."""

    df: DataFrame
    label: str = ""
    executed_at: datetime | None = None
    truncated: bool = False
    query: str = ""
    rows_seen: int | None = None  # how many rows the read had, where that was counted


@dataclass(frozen=True)
class Pair:
    """A source column set against a target column, under a label (the target name by default)."""

    source: str
    target: str
    label: str = ""

    @property
    def name(self) -> str:
        return self.label or self.target.strip("[]")


def pair(spec: "Pair | tuple | str") -> Pair:
    if isinstance(spec, Pair):
        return spec
    return Pair(spec, spec) if isinstance(spec, str) else Pair(*spec)


def pairs(specs: Sequence) -> list[Pair]:
    return [pair(s) for s in specs]


@dataclass(frozen=True)
class Rel:
    """Many-to-one relationship. Only one relationship between two tables is active."""

    from_table: str
    from_col: str
    to_table: str
    to_col: str
    active: bool = True
    confidence: float = 1.0


@dataclass(frozen=True)
class Measure:
    """A named aggregate. ``kind`` is sum, avg, count, distinct, min, max or count_rows.

    ``value`` is a column or any row expression; ``where`` holds predicates that must all be true
    for a row to count. ``refine`` adds one more predicate and leaves the rest in force.
    """

    name: str
    kind: str
    value: Column | None = None
    where: tuple[Column, ...] = field(default_factory=tuple)

    def refine(self, predicate: Column, name: str | None = None) -> "Measure":
        return Measure(name or self.name, self.kind, self.value, self.where + (predicate,))

    @property
    def input(self) -> Column:
        value = F.lit(1) if self.value is None else self.value
        if not self.where:
            return value
        condition = self.where[0]
        for p in self.where[1:]:
            condition = condition & p
        return F.when(condition, value)


@dataclass(frozen=True)
class Model:
    """Tables by name and the relationships between them. Rows stay in Spark."""

    tables: dict[str, DataFrame]
    relationships: tuple[Rel, ...] = ()

    def active(self, from_table: str, to_table: str) -> Rel:
        for r in self.relationships:
            if r.active and (r.from_table, r.to_table) == (from_table, to_table):
                return r
        raise ValueError(f"no active relationship from {from_table} to {to_table}")


def resolve(df: DataFrame, name: str) -> str | None:
    """The column called ``name``; ``[name]`` and ``name`` are the same column."""
    if name in df.columns:
        return name
    bare = name.strip("[]")
    return next((c for c in df.columns if c.strip("[]") == bare), None)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
