"""Helpers for writing generated Spark SQL expressions."""

from __future__ import annotations

from itertools import count


def quote(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Names:
    """Fresh lambda variable names, so nested lambdas never shadow each other."""

    def __init__(self, prefix: str = "x"):
        self._prefix = prefix
        self._next = count()

    def __call__(self) -> str:
        return f"{self._prefix}{next(self._next)}"


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it by name inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(terms: list[str]) -> str:
    """Sum of integer terms with the constant ones folded."""
    fixed = sum(int(t) for t in terms if t.isdigit())
    rest = [t for t in terms if not t.isdigit()]
    if fixed or not rest:
        rest.append(str(fixed))
    return rest[0] if len(rest) == 1 else "(" + " + ".join(rest) + ")"
