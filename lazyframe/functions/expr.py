"""Lambdas traced into column expressions, so that predicates reach the scan and stay in generated code.

``lambda r: r.a > 5`` gets a row whose fields are columns; ``lambda a, b: a * b`` gets the
columns themselves. ``mean(x)`` and its kin mean an aggregate in ``combine`` and the same
aggregate over the group in ``select``, ``transform`` and ``subset``, where it is computed
once a group and joined to the rows. What can't be traced is marked by ``by_row`` and runs
as a vectorised pandas function, or, in groups, as a function of the group's vectors, which
``vectors`` turns into columns where it can.
"""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP: contextvars.ContextVar[Captured | None] = contextvars.ContextVar("group", default=None)
_PROPAGATE: contextvars.ContextVar[bool] = contextvars.ContextVar("propagate", default=False)


class Row:
    """Stands for a row (or a struct of columns) while a lambda is traced."""

    def __init__(self, columns: list[str], wrap: Callable[[str], Column] = F.col):
        self._columns, self._wrap = columns, wrap

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._columns:
            raise AttributeError(f"no column {name!r} among {self._columns}")
        return self._wrap(quoted(name))

    def __getitem__(self, name: str | int) -> Column:
        name = self._columns[name - 1] if isinstance(name, int) else name
        if name not in self._columns:
            raise KeyError(f"no column {name!r} among {self._columns}")
        return self._wrap(quoted(name))

    def __bool__(self):
        raise TypeError("a row has no truth value; combine conditions by & | ~")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Opaque:
    """A function that isn't traced; see ``by_row``."""

    def __init__(self, f: Callable, returns: str, many: bool = False):
        self.f, self.returns, self.many = f, returns, many


def by_row(f: Callable, returns: str, many: bool = False) -> Opaque:
    """Marks a plain function, with the Spark type of its results. It hides the predicate from the scan.

    Of a table it gets the values of a row, in pandas batches. Of a group it gets the group's
    columns as pandas series: in ``combine`` it gives one value, or with ``many`` any number
    of them, a row each; in ``select``, ``transform`` and ``subset`` one value for all rows of
    the group or a value for each. There it is first tried on stand-ins (see ``vectors``), so
    it must depend on nothing but its vectors.
    """
    return Opaque(f, returns, many)


class Captured:
    """Gathers the aggregates of a traced function; each becomes a column of the groups' table.

    ``level``: how many such tables are joined to the rows before an aggregate can be computed.
    """

    def __init__(self, taken: list[str]):
        self.taken, self.made, self.level = {c.lower() for c in taken}, {}, {}

    def take(self, aggregate: Column, level: int = 0) -> Column:
        k = len(self.made)
        while (name := f"_agg{k}") in self.taken or name in self.made:
            k += 1
        self.made[name], self.level[name] = aggregate, level
        return F.col(quoted(name))

    def copy(self) -> Captured:
        other = Captured(list(self.taken))
        other.made, other.level = dict(self.made), dict(self.level)
        return other


def call(f, columns: list[Column]) -> Column:
    """``f`` on columns: traced, or as a pandas function."""
    if isinstance(f, Opaque):

        @F.pandas_udf(f.returns)
        def run(*series):
            import pandas as pd

            return pd.Series([f.f(*values) for values in zip(*series, strict=True)])

        return run(*columns)
    got = f(*columns)
    return got if isinstance(got, Column) else F.lit(got)


@contextlib.contextmanager
def over(group: Captured | None, propagate: bool = False):
    """While it holds, aggregates are gathered in ``group`` and stand for its columns."""
    a, b = _GROUP.set(group), _PROPAGATE.set(propagate)
    try:
        yield
    finally:
        _GROUP.reset(a)
        _PROPAGATE.reset(b)


def _aggregate(make: Callable[[Column], Column], x: Column) -> Column:
    group = _GROUP.get()
    got = make(x)
    if _PROPAGATE.get():  # a missing value makes the whole aggregate missing
        got = F.when(F.count(F.lit(1)) == F.count(x), got)
    return got if group is None else group.take(got)


def mean(x: Column) -> Column:
    return _aggregate(F.avg, x)


def total(x: Column) -> Column:
    return _aggregate(F.sum, x)


def minimum(x: Column) -> Column:
    return _aggregate(F.min, x)


def maximum(x: Column) -> Column:
    return _aggregate(F.max, x)


def nrow(*_: Column) -> Column:
    group = _GROUP.get()
    return F.count(F.lit(1)) if group is None else group.take(F.count(F.lit(1)))


nrow.label, mean.label, total.label, minimum.label, maximum.label = "nrow", "mean", "sum", "minimum", "maximum"
#: Names that stand for aggregates where a function is asked for.
AGGREGATES = {"nrow": nrow, "mean": mean, "sum": total, "minimum": minimum, "maximum": maximum}


def label(f) -> str:
    """The part of an output's name that a function gives; "function" for lambdas."""
    name = getattr(f, "label", None) or getattr(f, "__name__", "<lambda>")
    return "function" if name == "<lambda>" or isinstance(f, Opaque) else name


def fdiv(a: Column, b: Column) -> Column:
    """Floating division as IEEE 754 has it: infinite or not a number by 0, where SQL would fail."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.when(F.isnan(a), a).otherwise(by_zero)).otherwise(F.try_divide(a, b))


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves to the even neighbour."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def normal_cdf(x: Column) -> Column:
    """Of the standard normal distribution, by formula 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)
