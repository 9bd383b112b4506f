"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.types import Column, Literal


@dataclass(frozen=True)
class ColumnRef:
    column: str
    table: str = ""


@dataclass(frozen=True)
class Value:
    """A column, or an aggregate over one; func COUNT without a column is COUNT(*)."""

    ref: ColumnRef | None
    func: str = ""


@dataclass(frozen=True)
class Item:
    value: Value
    alias: str = ""


@dataclass(frozen=True)
class Comparison:
    left: Value
    op: str
    right: ColumnRef | Literal


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str = ""

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    table: TableRef
    on: tuple[Comparison, ...]


@dataclass(frozen=True)
class OrderKey:
    value: Value
    descending: bool = False


@dataclass(frozen=True)
class Select:
    """items empty is SELECT *."""

    items: tuple[Item, ...]
    source: TableRef
    joins: tuple[Join, ...] = ()
    where: tuple[Comparison, ...] = ()
    group_by: tuple[ColumnRef, ...] = ()
    having: tuple[Comparison, ...] = ()
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None

    @property
    def tables(self) -> tuple[TableRef, ...]:
        return (self.source, *(j.table for j in self.joins))


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...] = field(default=())


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Transaction:
    """action: BEGIN, COMMIT or ROLLBACK."""

    action: str


Statement = Select | CreateTable | CreateIndex | Insert | Transaction
