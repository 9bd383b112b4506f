"""Grouping before a join: rows of a table alike in all that the join and the groups read go as one, with their number.

Joins of many rows with many make their product otherwise, only to add it up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.binder import Aggregate, Bound, BoundSelect, Term
from .relations import filter_rows, never


def _names(term: Term) -> set[str]:
    return {term.left.name} | ({term.right.name} if isinstance(term.right, Bound) else set())


def _weight(table: int) -> str:
    return f"t{table}rows"


class Collapsed:
    """The tables of a grouped join that are collapsed, and what is left of the terms."""

    def __init__(self, bound: BoundSelect, keys: list[str | None]):
        """keys: the unique column of each table. Two tables at least have to be without theirs, or it does not pay."""
        self.own = [{c.name for c in columns} for _, columns in bound.tables]
        local = lambda t: any(_names(t) <= names for names in self.own)
        every = [*bound.where, *(t for terms in bound.on for t in terms)]
        self.local = [t for t in every if local(t)]
        self.where = [t for t in bound.where if not local(t)]
        self.on = [[t for t in terms if not local(t)] for terms in bound.on]
        self.needed = {g.name for g in bound.groups}.union(*(_names(t) for t in every if not local(t)))
        self.tables = [i for i, key in enumerate(keys) if key not in self.needed]
        self.aggregates = bound.aggregates

    @classmethod
    def of(cls, bound: BoundSelect, keys: list[str | None]) -> Collapsed | None:
        if bound.groups is None or len(bound.tables) < 2 or never(bound.where) or any(map(never, bound.on)):
            return None
        out = cls(bound, keys)
        return out if len(out.tables) > 1 else None

    def table(self, i: int, df: DataFrame) -> DataFrame:
        """The filtered rows of a table; collapsed, with partial aggregates of the columns that are added up later."""
        df = filter_rows(df, [t for t in self.local if _names(t) <= self.own[i]])
        if i not in self.tables:
            return df
        parts = {}
        for a in self.aggregates:
            if a.argument and a.argument.name in self.own[i]:
                for what in _PARTS[a.func]:
                    parts[f"{a.argument.name}{what}"] = _part(what, F.col(a.argument.name))
        keys = [c for c in df.columns if c in self.needed]
        made = [F.count(F.lit(1)).alias(_weight(i)), *(c.alias(name) for name, c in parts.items())]
        # A table without a column of its own in use is one row, or none if it is empty.
        return df.groupBy(*keys).agg(*made).filter(F.col(_weight(i)) > 0)

    def group(self, df: DataFrame, groups: list[Bound]) -> DataFrame:
        if not self.aggregates:
            return df.select(*(g.name for g in groups)).distinct() if groups else df.agg(F.count(F.lit(1)).alias("a0"))
        return df.groupBy(*(g.name for g in groups)).agg(*(self._total(a).alias(a.name) for a in self.aggregates))

    def _total(self, a: Aggregate) -> SparkColumn:
        if a.argument is None:
            return self._count(F.lit(1), self.tables)
        name = a.argument.name
        owner = next((i for i in self.tables if name in self.own[i]), None)
        others = [i for i in self.tables if i != owner]
        part = lambda what: F.col(f"{name}{what}") if owner is not None else _row(what, F.col(name))
        if a.func in ("MIN", "MAX"):
            return (F.min if a.func == "MIN" else F.max)(part(a.func.lower()))
        if a.func == "COUNT":
            return self._count(part("n"), others)
        total = F.sum(self._times(part("sum").cast("decimal(38,0)"), others))
        fits = total.isNull() | total.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
        total = F.when(fits, total.cast("bigint")).otherwise(F.raise_error(F.lit("[ARITHMETIC_OVERFLOW] long overflow")).cast("bigint"))
        return total if a.func == "SUM" else total.cast("double") / self._count(part("n"), others)

    def _count(self, one: SparkColumn, others: list[int]) -> SparkColumn:
        return F.coalesce(F.sum(self._times(one.cast("bigint"), others)), F.lit(0).cast("bigint"))

    def _times(self, one: SparkColumn, others: list[int]) -> SparkColumn:
        return reduce(lambda x, i: x * F.col(_weight(i)), others, one)


_PARTS = {"COUNT": ("n",), "SUM": ("sum",), "AVG": ("sum", "n"), "MIN": ("min",), "MAX": ("max",)}


def _part(what: str, column: SparkColumn) -> SparkColumn:
    """Exact sums, which rows that meet none may not make overflow."""
    match what:
        case "n":
            return F.count(column)
        case "sum":
            return F.sum(column.cast("decimal(19,0)"))
    return F.min(column) if what == "min" else F.max(column)


def _row(what: str, column: SparkColumn) -> SparkColumn:
    return column.isNotNull().cast("int") if what == "n" else column
