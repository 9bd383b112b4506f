"""Plan text: the steps with the rows each produced, how Spark joins and reads, and Spark's own plan."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.lower import PlanStep

WIDTH = 60
_JOIN = re.compile(r"\b(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct)\b")
_READ = re.compile(r"PushedFilters: \[([^\]]*)\]")


def watched(plan: Callable, select) -> PlanStep:
    """The plan made again with a count at every step, and run once."""
    seen: list[DataFrame] = []

    def watch(df: DataFrame) -> DataFrame:
        seen.append(df)
        return df.observe(f"step{len(seen) - 1}", F.count(F.lit(1)).alias("rows"))

    top = plan(select, watch)
    ran = top.df._jdf.queryExecution()
    ran.toRdd().count()
    metrics, counts = ran.observedMetrics(), {}
    for i in range(len(seen)):
        found = metrics.get(f"step{i}")
        counts[i] = found.get().getLong(0) if found.isDefined() else seen[i].count()  # a step the optimizer made away with
    rows = {f"step{i}": n for i, n in counts.items()}
    shown = ran.executedPlan().toString().split("== Initial Plan ==")[0]
    _name(top, rows, _JOIN.findall(shown), _READ.findall(shown))
    return top


def _name(top: PlanStep, rows: dict[str, int], joins: list[str], reads: list[str]) -> None:
    """Gives each step its rows, the joins their kinds and the scans their filters, in the plan's order."""
    steps: list[PlanStep] = []

    def walk(step: PlanStep) -> None:
        steps.append(step)
        for child in step.children:
            walk(child)

    walk(top)
    # Steps are made from the leaves up, left to right, scans first; the topmost select list adds no count of its own.
    made = [s for s in steps if not s.children] + [s for s in reversed(steps) if s.children]
    for i, step in enumerate(made):
        step.rows = rows.get(f"step{i}")
    if top.rows is None:
        top.rows = rows[f"step{len(rows) - 1}"]
    of = [s for s in steps if s.text.startswith("Join ")]
    if len(of) == len(joins):
        for step, kind in zip(of, joins, strict=True):
            step.text = kind + step.text.removeprefix("Join")
    scans = [s for s in steps if not s.children]
    if len(scans) == len(reads):
        for step, filters in zip(scans, reads, strict=True):
            step.detail = f"read with {filters}" if filters else ""


def text(step: PlanStep | None, estimates: bool = False, physical: bool = False) -> str:
    if step is None:
        return "(no SELECT has run)\n"
    lines: list[str] = []
    _lines(step, 0, estimates, lines)
    out = "\n".join(lines) + "\n"
    if physical:
        out += step.df._jdf.queryExecution().explainString(step.df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) + "\n"
    return out


def _lines(step: PlanStep, depth: int, estimates: bool, out: list[str]) -> None:
    head = "  " * depth + step.text
    line = head.ljust(WIDTH) if len(head) < WIDTH else head + " "
    line += f"rows={step.rows}"
    if estimates and step.estimate is not None:
        line += f" est={step.estimate}"
    out.append(line)
    if step.detail:
        out.append("  " * depth + "    " + step.detail)
    for child in step.children:
        _lines(child, depth + 1, estimates, out)
