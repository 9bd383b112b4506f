"""The engine as a program: statements from standard input or -c, results out."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .errors import SqlError
from .functions.types import Kind
from .session import Result, Session
from .sources.store import DURABILITY

USAGE = "usage: python -m tessera [--plain] [--durability full|normal|off] DATABASE [-c SQL]"


def cell(value, kind: Kind, places: int = 0) -> str:
    """A value as a person reads it."""
    if value is None:
        return "NULL"
    if kind is Kind.BOOL:
        return "TRUE" if value else "FALSE"
    return f"{value:.{places}f}" if kind is Kind.DOUBLE else str(value)


def plain_cell(value, kind: Kind) -> str:
    if value is None:
        return "NULL"
    if kind is Kind.BOOL:
        return "t" if value else "f"
    return f"{value:.17g}" if kind is Kind.DOUBLE else str(value)


def table_lines(r: Result, places: int = 0) -> list[str]:
    """Aligned columns: text to the left, everything else to the right (columns of NULLs to the left)."""
    shown = [[cell(v, k, places) for v, k in zip(row, r.kinds, strict=True)] for row in r.rows]
    out = [r.columns, ["" for _ in r.columns], *shown]
    widths = [max([len(h.encode()), *(len(row[i].encode()) for row in shown)]) for i, h in enumerate(r.columns)]
    out[1] = ["-" * w for w in widths]
    right = [k is not Kind.TEXT and any(row[i] is not None for row in r.rows) for i, k in enumerate(r.kinds)]
    pad = lambda v, i: " " * (widths[i] - len(v.encode()))
    return ["  ".join(pad(v, i) + v if right[i] else v + pad(v, i) for i, v in enumerate(row)).rstrip(" ") for row in out]


def split(text: str) -> tuple[list[str], str]:
    """Complete statements, and what follows the last semicolon outside quotes."""
    parts, start, quoted = [], 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif c == ";" and not quoted:
            parts.append(text[start:i])
            start = i + 1
    return parts, text[start:]


class Shell:
    def __init__(self, session: Session, plain: bool = False, out: TextIO | None = None, err: TextIO | None = None):
        self.session, self.plain, self.out, self.err = session, plain, out or sys.stdout, err or sys.stderr
        self.errors = 0

    def say(self, text: str, to: TextIO | None = None) -> None:
        print(text, file=to or self.out, flush=True)

    def run(self, sql: str) -> None:
        sql = sql.lstrip(" \t\r\n")
        if not sql:
            return
        try:
            self.show(self.session.query(sql))
        except SqlError as e:
            self.say(f"error: {e.render(sql)}", self.err)
            self.errors += 1
        except Exception as e:
            self.say(f"error: {e}", self.err)
            self.errors += 1

    def show(self, r: Result) -> None:
        if not r.columns:
            return
        if self.plain:
            for row in r.rows:
                self.say("|".join(plain_cell(v, k) for v, k in zip(row, r.kinds, strict=True)))
            return
        for line in table_lines(r):
            self.say(line)
        self.say(f"({len(r.rows)} row{'' if len(r.rows) == 1 else 's'})\n")

    def command(self, line: str) -> bool:
        """A shell command; False ends the session."""
        if line == ".quit":
            return False
        if line == ".explain":
            self.out.write(self.session.explain_last(estimates=True))
        elif line == ".tables":
            for name in self.session.table_names():
                self.say(f"{name}: {self.session.row_count(name)} rows" + "".join(f", index on {c}" for c in self.session.indexed(name)))
        else:
            self.say(f"unknown command: {line}", self.err)
        return True

    def read(self, lines: TextIO, prompt: str = "") -> int:
        pending = ""
        while True:
            if prompt:
                self.out.write(f"{prompt}> " if not pending else "   ...> ")
                self.out.flush()
            line = lines.readline()
            if not line:
                break
            line = line.rstrip("\n")
            if not pending and line.startswith("."):
                if not self.command(line):
                    break
                continue
            done, pending = split(pending + line + "\n")
            for sql in done:
                self.run(sql)
            if not pending.strip(" \t\r\n"):
                pending = ""
        self.run(pending)
        if self.session.close():
            self.say("a transaction was still open: rolled back", self.err)
        return 1 if self.errors else 0


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    plain, durability, path, command = False, "full", "", None
    rest = list(argv)
    while rest:
        a = rest.pop(0)
        if a == "--plain":
            plain = True
        elif a == "--durability" and rest and rest[0] in DURABILITY:
            durability = rest.pop(0)
        elif a == "-c" and rest:
            command = rest.pop(0)
        elif a and not a.startswith("-") and not path:
            path = a
        else:
            path = ""
            break
    if not path:
        print(USAGE, file=sys.stderr)
        return 2
    if spark is None:
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
    session = Session(spark, path, durability=durability, deterministic=True)
    if session.store.recovery.transactions:
        print(f"recovered: {session.store.recovery.transactions} transactions, {session.store.recovery.discarded} files without a commit", file=sys.stderr)
    shell = Shell(session, plain)
    if command is not None:
        done, last = split(command)
        for sql in [*done, last]:
            shell.run(sql)
        shell.session.close()
        return 1 if shell.errors else 0
    if interactive := sys.stdin.isatty():
        print(f"tessera -- {path} (statements end with ';', .quit to leave)")
    return shell.read(sys.stdin, "tessera" if interactive else "")
