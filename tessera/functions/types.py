"""The dialect's types and how they map to Spark's."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    INT64 = "INT64"
    INT32 = "INT32"
    BOOL = "BOOL"
    TEXT = "TEXT"
    DOUBLE = "DOUBLE"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def family(self) -> str:
        """Values compare only within a family."""
        return {Kind.TEXT: "text", Kind.BOOL: "bool"}.get(self, "number")

    @property
    def is_integer(self) -> bool:
        return self in (Kind.INT64, Kind.INT32)


_SPARK = {Kind.INT64: T.LongType(), Kind.INT32: T.IntegerType(), Kind.BOOL: T.BooleanType(), Kind.TEXT: T.StringType(), Kind.DOUBLE: T.DoubleType()}
_FROM_SPARK = {T.LongType: Kind.INT64, T.IntegerType: Kind.INT32, T.ShortType: Kind.INT32, T.ByteType: Kind.INT32, T.BooleanType: Kind.BOOL, T.StringType: Kind.TEXT, T.DoubleType: Kind.DOUBLE, T.FloatType: Kind.DOUBLE}


def kind_of(spark_type: T.DataType) -> Kind | None:
    return _FROM_SPARK.get(type(spark_type))


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    nullable: bool = True


@dataclass(frozen=True)
class Literal:
    """A literal as parsed: any integer is INT64; NULL has no kind of its own."""

    value: int | float | bool | str | None
    kind: Kind | None

    @property
    def is_null(self) -> bool:
        return self.kind is None
