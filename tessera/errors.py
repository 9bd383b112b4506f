"""Errors of the dialect. Positions are 1-based and name the statement's own lines."""

from __future__ import annotations


class SqlError(Exception):
    """Base of everything a statement can raise."""

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message

    def render(self, sql: str = "") -> str:
        return self.message


class PositionedError(SqlError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(message)
        self.line, self.column = line, column

    def render(self, sql: str = "") -> str:
        """The message with the offending line and a caret under the place."""
        if not sql:
            return self.message
        lines = sql.split("\n")
        shown = lines[self.line - 1] if self.line <= len(lines) else ""
        return f"parse error at line {self.line}, column {self.column}: {self.message}\n    {shown}\n    {' ' * (self.column - 1)}^"


class LexError(PositionedError):
    """Text that is no token."""


class ParseError(PositionedError):
    """Tokens that are no statement."""


class ExecError(SqlError):
    """A statement that cannot be bound or run."""


class LimitError(SqlError):
    """A size limit of the storage format (strict_limits)."""
