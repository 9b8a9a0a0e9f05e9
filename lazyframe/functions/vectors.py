"""Functions of a group's vectors, traced into column expressions where they do only what Spark can do too.

A ``by_row`` function of ``select``, ``transform`` or ``subset`` is called on stand-ins for the group's pandas series.
They record arithmetic, comparisons, rounding, ranks and the group's mean, sum, least, greatest, spread, count and median,
with the results of pandas on doubles: NaN and NULL are both missing, aggregates skip them, comparisons with them are
false. Then the groups' figures are computed once a group and joined to the rows, and no worker holds a group. Whatever
else a function does with a stand-in ends the attempt, and it is run on real series.
"""

from __future__ import annotations

import operator as op

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Captured, Opaque

_RETURNS = {"double": "double", "boolean": "boolean", "long": "long", "bigint": "long"}
_UFUNCS = {"add": op.add, "subtract": op.sub, "multiply": op.mul, "divide": op.truediv, "less": op.lt, "less_equal": op.le, "greater": op.gt, "greater_equal": op.ge, "equal": op.eq, "not_equal": op.ne}


def _present(x: Column) -> Column:
    """NULL for NaN."""
    return F.nanvl(x, F.lit(None).cast("double"))


class Untraced(TypeError):
    """The function needs real series."""


class Placed:
    """What needs the order of a group's values: "median", or a method of ``Series.rank``."""

    def __init__(self, how: str, value: Column, ascending: bool = True):
        self.how, self.value, self.ascending = how, value, ascending

    def __str__(self) -> str:
        return f"{self.how}({self.value}, {self.ascending})"


class _Trace:
    def __init__(self, group: Captured):
        self.group, self.failed = group, False

    def fail(self, what: str):
        """Remembered, so that a function that catches the error is not believed."""
        self.failed = True
        raise Untraced(f"{what} needs the whole vector")


class Vector:
    """Stands for a group's column, or with ``whole`` for one value of the group.

    ``level``: how many joins of groups' figures come before it; its own figures come one later.
    """

    def __init__(self, trace: _Trace, column: Column, kind: str = "double", level: int = 0, whole: bool = False):
        self.__dict__.update(_trace=trace, _column=column, _kind=kind, _level=level, _whole=whole)

    def __getattr__(self, name: str):
        self._trace.fail(name)

    def __setattr__(self, name: str, value):
        self._trace.fail(f"setting {name}")

    @property
    def __class__(self):
        """Asked for by ``isinstance`` of another class."""
        self._trace.fail("isinstance")

    def _made(self, column: Column, kind: str = "double", *others: Vector) -> Vector:
        every = (self, *others)
        column = _present(column) if kind == "double" else column
        return Vector(self._trace, column, kind, max(v._level for v in every), all(v._whole for v in every))

    def _is(self, kind: str, what: str) -> None:
        if self._kind != kind:
            self._trace.fail(f"{what} of {self._kind}")

    # -- element-wise ------------------------------------------------------------------------------------
    def _pair(self, other, f, kind: str = "double") -> Vector:
        import numpy as np

        self._is("double", "arithmetic")
        if isinstance(other, Vector):
            other._is("double", "arithmetic")
            return self._made(f(self._column, other._column), kind, other)
        if isinstance(other, bool | np.bool_) or not isinstance(other, int | float | np.integer | np.floating):
            self._trace.fail(f"arithmetic with {type(other).__name__}")
        return self._made(f(self._column, _present(F.lit(float(other)))), kind)

    def __add__(self, other):
        return self._pair(other, lambda a, b: a + b)

    def __radd__(self, other):
        return self._pair(other, lambda a, b: b + a)

    def __sub__(self, other):
        return self._pair(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self._pair(other, lambda a, b: b - a)

    def __mul__(self, other):
        return self._pair(other, lambda a, b: a * b)

    def __rmul__(self, other):
        return self._pair(other, lambda a, b: b * a)

    def __truediv__(self, other):
        return self._pair(other, _quotient)

    def __rtruediv__(self, other):
        return self._pair(other, lambda a, b: _quotient(b, a))

    def __neg__(self):
        self._is("double", "-")
        return self._made(-self._column)

    def __abs__(self):
        self._is("double", "abs")
        return self._made(F.abs(self._column))

    def abs(self):
        if self._whole:
            self._trace.fail("abs")
        return abs(self)

    def __round__(self, digits=None):
        if digits is None and self._whole:
            self._trace.fail("round")
        return self.round(digits or 0)

    def round(self, decimals=0):
        """As numpy rounds: scaled, halves to the even neighbour, scaled back."""
        self._is("double", "round")
        if isinstance(decimals, bool) or not isinstance(decimals, int) or not 0 <= decimals <= 22:
            self._trace.fail(f"round to {decimals}")
        scale = F.lit(float(10**decimals))
        return self._made(F.rint(self._column * scale) / scale if decimals else F.rint(self._column))

    def _compared(self, other, f, missing: bool = False) -> Vector:
        return self._pair(other, lambda a, b: F.coalesce(f(a, b), F.lit(missing)), "boolean")

    def __lt__(self, other):
        return self._compared(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compared(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._compared(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compared(other, lambda a, b: a >= b)

    def __eq__(self, other):
        return self._compared(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._compared(other, lambda a, b: a != b, True)

    __hash__ = None

    def _both(self, other, f) -> Vector:
        self._is("boolean", "logic")
        if not isinstance(other, Vector):
            self._trace.fail(f"logic with {type(other).__name__}")
        other._is("boolean", "logic")
        return self._made(f(self._column, other._column), "boolean", other)

    def __and__(self, other):
        return self._both(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._both(other, lambda a, b: a | b)

    def __invert__(self):
        self._is("boolean", "~")
        return self._made(~self._column, "boolean")

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        """A number of numpy's on the left."""
        import numpy as np

        f = _UFUNCS.get(ufunc.__name__)
        if method != "__call__" or options or f is None:
            self._trace.fail(ufunc.__name__)
        return f(*[x if isinstance(x, Vector) or not isinstance(x, np.generic) else x.item() for x in inputs])

    def astype(self, kind):
        """Missing and infinite values have no integer, as in pandas."""
        self._is("double", "astype")
        if kind in ("float64", float):
            return self
        if kind not in ("int64", int):
            self._trace.fail(f"astype {kind}")
        wrong = F.raise_error(F.lit("cannot convert non-finite values to integer")).cast("long")
        return self._made(F.when(self._column.isNull() | (F.abs(self._column) == float("inf")), wrong).otherwise(self._column.cast("long")), "long")

    # -- of the group ------------------------------------------------------------------------------------
    def _figure(self, made) -> Vector:
        self._is("double", "an aggregate")
        if self._whole:
            self._trace.fail("an aggregate of one value")
        return Vector(self._trace, _present(self._trace.group.take(made, self._level).cast("double")), "double", self._level + 1, True)

    def mean(self):
        return self._figure(F.avg(self._column))

    def sum(self):
        return self._figure(F.coalesce(F.sum(self._column), F.lit(0.0)))

    def min(self):
        return self._figure(F.min(self._column))

    def max(self):
        return self._figure(F.max(self._column))

    def std(self):
        return self._figure(F.stddev_samp(self._column))

    def var(self):
        return self._figure(F.var_samp(self._column))

    def count(self):
        return self._figure(F.count(self._column))

    def median(self):
        return self._figure(Placed("median", self._column))

    def rank(self, method="average", ascending=True):
        if method not in ("average", "min", "max", "dense") or not isinstance(ascending, bool):
            self._trace.fail(f"rank by {method}")
        made = self._figure(Placed(method, self._column, ascending))
        return Vector(self._trace, made._column, "double", made._level, False)


def _no(name: str):
    def run(self, *_, **__):
        self._trace.fail(name)

    return run


#: What Python looks up on the class, so that ``__getattr__`` isn't asked.
for _name in ("array", "array_function", "bool", "bytes", "call", "complex", "contains", "delitem", "divmod", "enter", "exit", "float", "floordiv", "format", "getitem", "index", "int", "iter", "len",
              "matmul", "mod", "next", "pos", "pow", "rand", "rdivmod", "repr", "reversed", "rfloordiv", "rmatmul", "rmod", "ror", "rpow", "rxor", "setitem", "str", "trunc", "xor"):
    setattr(Vector, f"__{_name}__", _no(f"__{_name}__"))


def _quotient(a: Column, b: Column) -> Column:
    """As IEEE 754 has it, by the sign of zero too."""
    by_zero = F.when(a.isNull() | (a == 0), F.lit(None).cast("double")).when((a > 0) == (b.cast("string") == "0.0"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def traced(f: Opaque, columns: list[Column], kinds: list[str], group: Captured) -> Column | None:
    """What ``f`` gives each row, its figures taken by ``group``; None if it must run on real series.

    It is called twice: one that gives something else the second time isn't a function of its vectors.
    """
    if not columns or any(k != "double" for k in kinds):
        return None
    runs = []
    for _ in range(2):
        own = group.copy()
        trace = _Trace(own)
        try:
            got = f.f(*[Vector(trace, _present(c)) for c in columns])
        except Exception:  # whatever it is, it comes again with real series
            return None
        if trace.failed or not isinstance(got, Vector) or got._trace is not trace or got._kind != _RETURNS.get(f.returns.strip().lower()):
            return None
        runs.append((got._column, own))
    (column, own), (again, other) = runs
    if str(column) != str(again) or {n: str(c) for n, c in own.made.items()} != {n: str(c) for n, c in other.made.items()}:
        return None
    group.made, group.level = own.made, own.level
    return column
