"""What can go wrong, by the phase that finds it."""

from __future__ import annotations


class LogicError(Exception):
    """Base of all errors; pos is (line, column) where it is known, define the statement."""

    def __init__(self, message: str, pos: tuple[int, int] | None = None, define: str | None = None):
        self.message, self.pos, self.define = message, pos, define
        super().__init__(f"{message}" + (f" (line {pos[0]}, column {pos[1]})" if pos else "") + (f" in {define!r}" if define else ""))


class SyntaxFault(LogicError):
    """The text is not a library or expression."""


class SemanticFault(LogicError):
    """A name, type or overload doesn't fit."""


class EvaluationFault(LogicError):
    """A value can't be computed."""


class TimeoutFault(EvaluationFault):
    """The evaluation took longer than its limit."""


class TooCostlyFault(EvaluationFault):
    """A size or depth limit is exceeded."""
