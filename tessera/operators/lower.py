"""A bound SELECT as a DataFrame, with the steps it took for the plan text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..plans.binder import BoundSelect, Term
from ..plans.nodes import Select, TableRef
from ..plans.render import condition_sql, ref_sql, value_sql
from . import grouping, ordering, relations
from .eager import Collapsed


@dataclass
class PlanStep:
    """A logical operator: its text, the rows below it, and (for scans) the row count known beforehand."""

    text: str
    df: DataFrame
    children: list[PlanStep] = field(default_factory=list)
    estimate: int | None = None
    #: Set once the plan has run for its text.
    rows: int | None = None
    detail: str = ""


@dataclass
class Source:
    """A table as the session hands it over."""

    df: DataFrame
    rows: int | None
    key: str | None
    indexed: frozenset[str]


def _scan_text(ref: TableRef) -> str:
    return f"SeqScan {ref.name}" + (f" AS {ref.alias}" if ref.alias else "")


def lower(select: Select, bound: BoundSelect, source_of: Callable[[str], Source], algorithm: str = "auto", deterministic: bool = False, watch: Callable[[DataFrame], DataFrame] | None = None) -> PlanStep:
    """Joins left-deep as written, WHERE above them; Catalyst pushes each term to the scan it belongs to.

    Tables joined many to many only to be grouped are grouped before.

    watch stands between the steps, to count the rows that pass. Full sorts, which
    leave the counts as they are, are then left out, as Spark reads their input
    twice to place the rows.
    """

    def made(text: str, df: DataFrame, children: list | None = None, estimate: int | None = None) -> PlanStep:
        return PlanStep(text, watch(df) if watch else df, children or [], estimate)

    sources = [source_of(ref.name) for ref, _ in bound.tables]
    keys, indexed, unique = [], set(), set()
    steps = []
    for (ref, columns), source in zip(bound.tables, sources, strict=True):
        steps.append(made(_scan_text(ref), relations.scan(source.df, columns), estimate=source.rows))
        for c in columns:
            if c.column.name == source.key:
                keys.append(c.name)
                indexed.add(c.name)
                unique.add(c.name)
            elif c.column.name in source.indexed:
                indexed.add(c.name)

    where, on = list(bound.where), bound.on
    # Plans that are watched, or that ask for the order of the rows joined, join every row.
    plain = algorithm != "auto" or deterministic or watch
    own = [next((c.name for c in columns if c.column.name == source.key), None) for (_, columns), source in zip(bound.tables, sources, strict=True)]
    collapsed = None if plain else Collapsed.of(bound, own)
    if collapsed:
        where, on = collapsed.where, collapsed.on
        for i, scanned in enumerate(steps):
            scanned.df = collapsed.table(i, scanned.df)

    step = steps[0]
    for i, right in enumerate(steps[1:]):
        terms = list(on[i])
        if algorithm != "auto":
            # A forced algorithm also gets the WHERE terms that this join makes checkable.
            have = set(step.df.columns) | set(right.df.columns)
            ready = [t for t in where if _names(t) <= have and not (_names(t) <= set(step.df.columns) or _names(t) <= set(right.df.columns))]
            terms += ready
            where = [t for t in where if t not in ready]
        text = condition_sql(select.joins[i].on)
        step = made(f"Join ON {text}", relations.join(step.df, right.df, terms, algorithm, text, indexed), [step, right])
    if where:
        step = made(f"Filter {condition_sql(select.where)}", relations.filter_rows(step.df, where), [step])
    elif bound.where and relations.never(bound.where):
        step = made("Filter", step.df.limit(0), [step])

    ties = keys
    if bound.groups is not None:
        text = ", ".join(map(ref_sql, select.group_by))
        named = list(dict.fromkeys(value_sql(v) for v in [*(i.value for i in select.items), *(c.left for c in select.having), *(o.value for o in select.order_by)] if v.func))
        head = ": ".join(filter(None, [f"GROUP BY {text}" if text else "", ", ".join(named)]))
        step = made(f"HashAggregate {head}", collapsed.group(step.df, bound.groups) if collapsed else grouping.group(step.df, bound.groups, bound.aggregates, keys if deterministic else None), [step])
        ties = [grouping.FIRST] if deterministic and bound.groups and keys else [g.name for g in bound.groups]
        unique = {bound.groups[0].name} if len(bound.groups) == 1 else set()
        if bound.having:
            step = made(f"Filter {condition_sql(select.having)}", relations.filter_rows(step.df, bound.having), [step])
    elif len(sources) > 1:
        unique = set()  # a join may repeat a key

    if bound.order:
        text = ", ".join(value_sql(o.value) + (" DESC" if o.descending else "") for o in select.order_by)
        top = "" if bound.limit is None else f" (top {bound.limit})"
        ordered = step.df if watch and bound.limit is None else ordering.sort(step.df, bound.order, ties, unique)
        step = made(f"Sort {text}{top}", ordering.limit(ordered, bound.limit), [step])
    else:
        if deterministic and ties:
            step = made("Sort", step.df if watch else ordering.sort(step.df, [], ties, set()), [step])
        if bound.limit is not None:
            step = made(f"Limit {bound.limit}", ordering.limit(step.df, bound.limit), [step])
    if select.items:
        shown = ", ".join(value_sql(i.value) + (f" AS {i.alias}" if i.alias else "") for i in select.items)
        return made(f"Project {shown}", relations.project(step.df, bound.output), [step])
    return PlanStep(step.text, relations.project(step.df, bound.output), step.children, step.estimate)


def _names(term: Term) -> set[str]:
    right = getattr(term.right, "name", None)
    return {term.left.name} | ({right} if right else set())
