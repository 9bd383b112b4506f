"""Scan, filter, join and projection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExecError
from ..functions.types import Literal
from ..plans.binder import Bound, Term

#: Forced join algorithms and the hint each stands for; index search has no Spark form but a broadcast of a small outer side.
JOIN_ALGORITHMS = ("auto", "nested_loop", "hash", "hash_left", "index_nested_loop")
#: A side is broadcast on request only up to this many bytes by Spark's own estimate.
BROADCAST_BYTES = 64 << 20

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def scan(df: DataFrame, columns: list[Bound]) -> DataFrame:
    """The table's columns under names unique in the whole plan, so self-joins and equal names cannot clash."""
    return df.toDF(*(c.name for c in columns))


def _as_integer(term: Term) -> SparkColumn | None:
    """An integer column against a decimal as a test of whole numbers, which files can answer from statistics.

    Exact while the decimal is within 2^53, where rounding a column's value to
    a double keeps its place among such numbers.
    """
    value = float(term.right.value)
    if not term.left.column.kind.is_integer or not abs(value) < 1 << 53:
        return None
    left, whole, low = F.col(term.left.name), value.is_integer(), math.floor(value)
    match term.op:
        case "=":
            return left == low if whole else F.lit(False)
        case "<>":
            return left != low if whole else left.isNotNull()
        case ">" | "<=":
            return _COMPARE[term.op](left, low)
    return _COMPARE[term.op](left, low if whole else low + 1)


def predicate(term: Term) -> SparkColumn:
    """NULL on either side is never true, as a filter drops what is not true."""
    left = F.col(term.left.name)
    if isinstance(term.right, Literal):
        if term.right.is_null:
            return F.lit(None).cast("boolean")
        if term.as_double and (exact := _as_integer(term)) is not None:
            return exact
        right = F.lit(float(term.right.value)) if term.as_double else F.lit(term.right.value)
    else:
        right = F.col(term.right.name)
    if term.as_double:
        left, right = left.cast("double"), right.cast("double")
    return _COMPARE[term.op](left, right)


def conjunction(terms: list[Term]) -> SparkColumn:
    return reduce(lambda a, b: a & b, map(predicate, terms))


def never(terms: list[Term]) -> bool:
    """Whether integer bounds on one column contradict each other, so nothing need be read."""
    bounds: dict[str, tuple[int, int]] = {}
    for t in terms:
        if isinstance(t.right, Literal):
            if t.right.is_null:
                return True
            if t.as_double or not t.left.column.kind.is_integer or t.op == "<>":
                continue
            lo, hi = bounds.get(t.left.name, (-(1 << 63), (1 << 63) - 1))
            v = t.right.value
            lo = max(lo, v + (t.op == ">")) if t.op in ("=", ">", ">=") else lo
            hi = min(hi, v - (t.op == "<")) if t.op in ("=", "<", "<=") else hi
            bounds[t.left.name] = lo, hi
    return any(lo > hi for lo, hi in bounds.values())


def filter_rows(df: DataFrame, terms: list[Term]) -> DataFrame:
    if never(terms):
        return df.limit(0)
    return df.filter(conjunction(terms)) if terms else df


def is_equality(term: Term, left: set[str], right: set[str]) -> bool:
    return term.op == "=" and isinstance(term.right, Bound) and ({term.left.name in left, term.right.name in left} == {True, False}) and ({term.left.name in right, term.right.name in right} == {True, False})


def join(left: DataFrame, right: DataFrame, terms: list[Term], algorithm: str, text: str, indexed: set[str]) -> DataFrame:
    """Inner join on all terms. `indexed`: names of key or indexed columns, for the index algorithm's check."""
    sides = set(left.columns), set(right.columns)
    equal = [t for t in terms if is_equality(t, *sides)]
    condition = conjunction(terms) if terms else F.lit(True)
    if algorithm in ("hash", "hash_left") and not equal:
        raise ExecError(f"a hash join needs an ON equality between a column of each table: {text}")
    if algorithm == "index_nested_loop" and not any(x in indexed for t in equal for x in (t.left.name, t.right.name)):
        raise ExecError(f"no index to search for an index nested-loop join: {text}")
    if algorithm == "nested_loop":
        return left.join(right.hint("shuffle_replicate_nl"), condition)
    if algorithm == "hash":
        return left.join(right.hint("shuffle_hash"), condition)
    if algorithm == "hash_left":
        return left.hint("shuffle_hash").join(right, condition)
    if algorithm == "index_nested_loop":
        # The side without the index is the outer one, whose rows go to where the other's lie.
        inner_right = any(x in indexed and x in sides[1] for t in equal for x in (t.left.name, t.right.name))
        if estimated_bytes(left if inner_right else right) <= BROADCAST_BYTES:
            return F.broadcast(left).join(right, condition) if inner_right else left.join(F.broadcast(right), condition)
    return left.join(right, condition)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def project(df: DataFrame, output: list[tuple[Bound, str]]) -> DataFrame:
    return df.select(*(F.col(c.name).alias(heading) for c, heading in output))
