"""Column selectors: names, one-based numbers, ranges, regular expressions, All, Between and Cols."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class All:
    """Every column."""


@dataclass(frozen=True)
class Between:
    """Columns from ``first`` to ``last``, both included; each a name or a one-based number."""

    first: str | int
    last: str | int


class Cols:
    """The union of several selectors, in their order and without repeats."""

    def __init__(self, *parts):
        self.parts = parts


def resolve(columns: list[str], selector) -> list[str]:
    """The names that ``selector`` means, in order; unknown ones raise KeyError."""
    if selector is None or isinstance(selector, All) or (isinstance(selector, slice) and selector == slice(None)):
        return list(columns)
    if isinstance(selector, bool):
        raise TypeError("a bool selects no column")
    if isinstance(selector, str):
        if selector not in columns:
            raise KeyError(f"no column {selector!r} among {columns}")
        return [selector]
    if isinstance(selector, int):
        if not 1 <= selector <= len(columns):
            raise KeyError(f"no column number {selector}; there are {len(columns)}")
        return [columns[selector - 1]]
    if isinstance(selector, re.Pattern):
        return [c for c in columns if selector.search(c)]
    if isinstance(selector, Between):
        first, last = (columns.index(resolve(columns, x)[0]) for x in (selector.first, selector.last))
        return columns[first : last + 1]
    parts = selector.parts if isinstance(selector, Cols) else selector
    if not isinstance(parts, Iterable):
        raise TypeError(f"{selector!r} selects no columns")
    return list(dict.fromkeys(name for part in parts for name in resolve(columns, part)))
