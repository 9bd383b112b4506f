"""Sort, top-n and limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.binder import Bound

_MOST = (1 << 31) - 1


def sort(df: DataFrame, keys: list[tuple[Bound, bool]], ties: list[str], unique: set[str]) -> DataFrame:
    """NULLs last ascending and first descending. Ties keep input order, that of the hidden columns `ties`.

    Keys after a unique, never-null column cannot matter and are dropped.
    """
    order, names = [], set()
    for column, descending in keys:
        if column.name in names:
            continue
        names.add(column.name)
        order.append(F.col(column.name).desc_nulls_first() if descending else F.col(column.name).asc_nulls_last())
        if column.name in unique:
            return df.orderBy(*order)
    return df.orderBy(*order, *(F.col(t).asc_nulls_last() for t in ties if t not in names))


def limit(df: DataFrame, n: int | None) -> DataFrame:
    """After a sort, Spark plans both as one top-n. Its own limit ends at 2^31 - 1 rows; beyond, rows are numbered."""
    if n is None:
        return df
    if n <= _MOST:
        return df.limit(n)
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().filter(lambda row: row[1] < n).map(lambda row: row[0]), df.schema)
