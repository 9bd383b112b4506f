"""A PySpark-native engine for a small, strict SQL dialect."""

from .errors import ExecError, LexError, LimitError, ParseError, SqlError
from .session import Result, Session

__all__ = ["ExecError", "LexError", "LimitError", "ParseError", "Result", "Session", "SqlError"]
