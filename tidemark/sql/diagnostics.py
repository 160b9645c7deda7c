"""Messages with source positions."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Severity(Enum):
    ERROR = "error"
    WARNING = "warning"
    HINT = "hint"


@dataclass(frozen=True)
class Position:
    """1-based line and column, counted in characters, and 0-based offset in UTF-8 bytes."""

    line: int
    column: int
    offset: int


@dataclass(frozen=True)
class Span:
    start: Position
    end: Position


@dataclass(frozen=True)
class Diagnostic(Exception):
    """Codes: 1000-1999 lexer, 2000-2999 parser, 3000-3999 meaning."""

    code: int
    category: str
    message: str
    span: Span
    source: str = field(default="", repr=False, compare=False)
    severity: Severity = Severity.ERROR

    def __str__(self) -> str:
        at = self.span.start
        return f"{at.line}:{at.column}: {self.severity.value} [E{self.code}] {self.category}: {self.message}"

    def snippet(self) -> str:
        lines = self.source.split("\n")
        a, b = self.span.start, self.span.end
        if not 0 < a.line <= len(lines) or not lines[a.line - 1]:
            return ""
        text = lines[a.line - 1]
        stop = b.column if a.line == b.line else len(text) + 1
        return f"  {text}\n  {' ' * (a.column - 1)}{'^' * max(1, stop - a.column)}"

    def full(self) -> str:
        return "\n".join(filter(None, [str(self), self.snippet()]))


class Diagnostics(list):
    """A list of Diagnostic; None is not appended."""

    def append(self, d: Diagnostic | None) -> None:
        if d is not None:
            super().append(d)

    def has_errors(self) -> bool:
        return any(d.severity is Severity.ERROR for d in self)

    def error(self) -> ExceptionGroup | None:
        """All of them as one exception; None without errors."""
        return ExceptionGroup("statement rejected", list(self)) if self.has_errors() else None

    def has_code(self, code: int) -> bool:
        return any(d.code == code for d in self)
