"""N-dimensional arrays.

A vector taken from a table stays a column of that table's plan, so that mapping vectors
of one table is a projection. Other arrays are tables of coordinates ``i1 .. iN`` (from 0)
and ``value``; two of them meet by their coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Opaque, call, quoted
from ..plans.kept import numbered

_REDUCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "and": F.bool_and, "or": F.bool_or}


class NDArray:
    def __init__(self, df: DataFrame | None, shape: tuple[int, ...] | None, table=None, column: Column | None = None):
        self._df, self._shape, self.table, self.column, self._memo = df, shape, table, column, None

    @classmethod
    def of_column(cls, table, name: str) -> NDArray:
        return cls(None, None, table, F.col(quoted(name)))

    # -- properties ------------------------------------------------------------------------------------
    @property
    def spark(self) -> DataFrame:
        """Coordinates and values; a table's vector is numbered in the order in which its plan reads."""
        if self._df is None:
            d, n = numbered(self.table.spark.select(self.column.alias("value")), "i1")
            self._df, self._shape = d.select("i1", "value"), (n,)
        return self._df

    @property
    def shape(self) -> tuple[int, ...]:
        if self._shape is None:
            self._shape = (self.table.nrow,)
        return self._shape

    size = shape

    @property
    def ndims(self) -> int:
        return len(self._shape) if self._shape else 1

    def __len__(self) -> int:
        return math.prod(self.shape)

    @property
    def eltype(self) -> str:
        return dict((self.table.spark.select(self.column.alias("value")) if self._df is None else self._df).dtypes)["value"]

    @property
    def axes(self) -> list[str]:
        return [f"i{k + 1}" for k in range(self.ndims)]

    def copy(self) -> NDArray:
        return NDArray(self._df, self._shape, self.table, self.column)

    deepcopy = copy

    def sample(self) -> DataFrame:
        from ..plans.sampling import take_sample

        return self.table.sample().select(self.column.alias("value")) if self._df is None else take_sample(self._df)[0]

    # -- element-wise ------------------------------------------------------------------------------------
    def map(self, f, *others: NDArray) -> NDArray:
        """Element by element; arrays of one table are one projection, others are joined by coordinates."""
        every = (self, *others)
        if all(a.table is not None and a.table is self.table and a.column is not None for a in every):
            return NDArray(None, self._shape, self.table, call(f, [a.column for a in every]))
        if any(a.shape != self.shape for a in others):
            raise ValueError(f"shapes differ: {[a.shape for a in every]}")
        df = self.spark.withColumnRenamed("value", "_v0")
        for k, a in enumerate(others, 1):
            df = df.join(a.spark.withColumnRenamed("value", f"_v{k}"), self.axes)
        made = call(f, [F.col(f"_v{k}") for k in range(len(every))])
        return NDArray(df.select(*self.axes, made.alias("value")), self.shape)

    def _with(self, other, f: Callable) -> NDArray:
        return self.map(f, other) if isinstance(other, NDArray) else self.map(lambda x: f(x, other))

    def __neg__(self):
        return self.map(lambda x: -x)

    def __add__(self, other):
        return self._with(other, lambda x, y: x + y)

    def __sub__(self, other):
        return self._with(other, lambda x, y: x - y)

    def __mul__(self, other):
        return self._with(other, lambda x, y: x * y)

    def __and__(self, other):
        return self._with(other, lambda x, y: x & y)

    def __or__(self, other):
        return self._with(other, lambda x, y: x | y)

    def __invert__(self):
        return self.map(lambda x: ~x)

    def __gt__(self, other):
        return self._with(other, lambda x, y: x > y)

    def __ge__(self, other):
        return self._with(other, lambda x, y: x >= y)

    def __lt__(self, other):
        return self._with(other, lambda x, y: x < y)

    def __le__(self, other):
        return self._with(other, lambda x, y: x <= y)

    def equals(self, other):
        return self._with(other, lambda x, y: x == y)

    # -- slices ------------------------------------------------------------------------------------------
    def mapslices(self, f, dims, returns: str | None = None) -> NDArray:
        """``f`` of every slice along ``dims`` (from 1); the result has length 1 along them.

        A traced ``f`` gets the slice's values as an array Column, in column-major order. A
        slice must fit a task; slices are spread over all of them.
        """
        dims = sorted([dims] if isinstance(dims, int) else dims)
        if not dims:
            return self.map(f)
        rest = [a for k, a in enumerate(self.axes, 1) if k not in dims]
        inner = [f"i{k}" for k in reversed(dims)]
        cells = F.transform(F.array_sort(F.collect_list(F.struct(*inner, "value"))), lambda x: x["value"])
        d = self.spark.groupBy(*rest).agg(cells.alias("cells")) if rest else self.spark.agg(cells.alias("cells"))
        value = call(f, [F.col("cells")])
        d = d.select(*[F.col(a) if a in rest else F.lit(0).cast("long").alias(a) for a in self.axes], value.alias("value"))
        return NDArray(d, tuple(1 if k in dims else n for k, n in enumerate(self.shape, 1)))

    def __getitem__(self, key) -> NDArray:
        """Colons, numbers and lists of numbers, all from 0, one for each axis; ``a[:]`` flattens column-major."""
        keys = key if isinstance(key, tuple) else (key,)
        every = slice(None)
        if keys == (every,) and self.ndims > 1:
            index, step = F.lit(0).cast("long"), 1
            for a, n in zip(self.axes, self.shape, strict=True):
                index, step = index + F.col(a) * step, step * n
            return NDArray(self.spark.select(index.alias("i1"), "value"), (len(self),))
        if len(keys) != self.ndims:
            raise IndexError(f"{self.ndims} indices are needed")
        d, kept, shape = self.spark, [], []
        for a, n, k in zip(self.axes, self.shape, keys, strict=True):
            if isinstance(k, slice):
                if k != every:
                    raise IndexError("only whole axes, numbers and lists of numbers")
                kept.append(F.col(a))
                shape.append(n)
                continue
            many = [k] if isinstance(k, int) else list(k)
            if any(not 0 <= x < n for x in many):
                raise IndexError(f"out of range along {a}")
            if isinstance(k, int):
                d = d.where(F.col(a) == k)
                continue
            places = d.sparkSession.createDataFrame([(x, p) for p, x in enumerate(many)], f"{a} long, _{a} long")
            d = d.join(places, a)
            kept.append(F.col(f"_{a}"))
            shape.append(len(many))
        if not kept:
            return NDArray(d.select(F.lit(0).cast("long").alias("i1"), "value"), (1,))
        return NDArray(d.select(*[c.alias(f"i{j}") for j, c in enumerate(kept, 1)], "value"), tuple(shape))

    # -- reductions --------------------------------------------------------------------------------------
    def reduce(self, op, dims=None, init=None):
        """``op``: "sum", "min", "max", "product", "and", "or", or an associative and commutative function of two values.

        Without ``dims`` a scalar (lazy, 1 by 1), else an array of length 1 along them. A
        plain function folds each partition, then the partitions' results on the driver.
        """
        if init is not None:
            raise ValueError("init isn't supported")
        plain = isinstance(op, str)
        if dims is None:
            d = self.table.spark.select(self.column.alias("value")) if self._df is None else self._df
            if plain:
                return Scalar(d.agg(_REDUCTIONS[op]("value").alias("value")))
            kind = dict(d.dtypes)["value"]

            def run(frames):
                import pandas as pd

                got = [fold(op, p["value"]) for p in frames if len(p)]
                yield pd.DataFrame({"value": [fold(op, got)] if got else []})

            parts = d.where("value is not null").mapInPandas(run, f"value {kind}")
            return Scalar(parts, lambda values: fold(op, values))
        dims = [dims] if isinstance(dims, int) else list(dims)
        rest = [a for k, a in enumerate(self.axes, 1) if k not in dims]
        made = _REDUCTIONS[op]("value") if plain else F.reduce(F.slice(F.collect_list("value"), 2, 2**31 - 1), F.element_at(F.collect_list("value"), 1), op)
        d = self.spark.groupBy(*rest).agg(made.alias("value")) if rest else self.spark.agg(made.alias("value"))
        d = d.select(*[F.col(a) if a in rest else F.lit(0).cast("long").alias(a) for a in self.axes], "value")
        return NDArray(d, tuple(1 if k in dims else n for k, n in enumerate(self.shape, 1)))

    def sum(self, dims=None):
        return self.reduce("sum", dims)

    def minimum(self, dims=None):
        return self.reduce("min", dims)

    def maximum(self, dims=None):
        return self.reduce("max", dims)

    # -- order -------------------------------------------------------------------------------------------
    def sort(self, rev: bool = False) -> NDArray:
        """A vector in order of its values."""
        if self.ndims != 1:
            raise ValueError("only vectors are sorted; see sortslices")
        return self.sortslices(1, rev)

    def sortslices(self, dims: int, rev: bool = False, by=None, order=None) -> NDArray:
        """Slices along axis ``dims`` in order of their first elements, then of the old place.

        The ranks come from a range exchange of the first elements, kept in the shared folder,
        and the counts of its partitions, not from one task.
        """
        if by is not None or order is not None:
            raise ValueError("by and order aren't supported")
        axis = f"i{dims}"
        d = self.spark
        first = d.where(" and ".join(f"{a} = 0" for a in self.axes if a != axis) or "true").select(F.col(axis).alias("_old"), "value")
        key = F.col("value").desc() if rev else F.col("value").asc()
        n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranks, _ = numbered(first.repartitionByRange(n, key, F.col("_old")).sortWithinPartitions(key, "_old"), "_new")
        if self.ndims == 1:
            return NDArray(ranks.select(F.col("_new").alias(axis), "value"), self.shape)
        out = d.join(ranks.select(F.col("_old").alias(axis), "_new"), axis).select(*[F.col("_new").alias(a) if a == axis else F.col(a) for a in self.axes], "value")
        return NDArray(out, self.shape)

    # -- results -----------------------------------------------------------------------------------------
    def compute(self) -> np.ndarray:
        """The values as a numpy array, kept with this handle."""
        if self._memo is None:
            p = self.spark.toPandas()
            values = p["value"].to_numpy()
            out = np.empty(self.shape, values.dtype)
            out[tuple(p[a].to_numpy() for a in self.axes)] = values
            self._memo = out
        return self._memo

    def compute_inplace(self) -> NDArray:
        from pyspark import StorageLevel

        self._df = self.spark.persist(StorageLevel.DISK_ONLY)
        self._df.count()
        return self

    def destroy(self) -> None:
        self._memo = None
        if self._df is not None:
            self._df.unpersist()


class Scalar:
    """A lazy single value."""

    def __init__(self, df: DataFrame, finish: Callable | None = None):
        self.spark, self.finish = df, finish

    def compute(self):
        rows = [r[0] for r in self.spark.collect()]
        return (self.finish(rows) if self.finish else rows[0]) if rows else None


def fill(spark: SparkSession, value, dims) -> NDArray:
    """Every element ``value``; one range, cut into coordinates."""
    shape = (dims,) if isinstance(dims, int) else tuple(dims)
    d, step, columns = spark.range(math.prod(shape)), 1, []
    for k, n in enumerate(shape, 1):
        columns.append((F.floor(F.col("id") / step) % n if step > 1 else F.col("id") % n).cast("long").alias(f"i{k}"))
        step *= n
    return NDArray(d.select(*columns, F.lit(value).alias("value")), shape)


def zeros(spark: SparkSession, dims, kind=float) -> NDArray:
    return fill(spark, kind(0), dims)


def ones(spark: SparkSession, dims, kind=float) -> NDArray:
    return fill(spark, kind(1), dims)


def trues(spark: SparkSession, dims) -> NDArray:
    return fill(spark, True, dims)


def falses(spark: SparkSession, dims) -> NDArray:
    return fill(spark, False, dims)


def collect_range(spark: SparkSession, start: int, stop: int, step: int = 1) -> NDArray:
    """The vector start, start + step, .. up to ``stop``, which is included."""
    n = max(0, (stop - start) // step + 1)
    return NDArray(spark.range(n).select(F.col("id").alias("i1"), (F.col("id") * step + start).alias("value")), (n,))


def from_numpy(spark: SparkSession, values: np.ndarray) -> NDArray:
    """A local array, sent to the cluster."""
    import pandas as pd

    at = np.indices(values.shape).reshape(values.ndim, -1)
    p = pd.DataFrame({f"i{k + 1}": at[k].astype(np.int64) for k in range(values.ndim)} | {"value": values.ravel()})
    return NDArray(spark.createDataFrame(p), values.shape)


__all__ = ["NDArray", "Opaque", "Scalar", "collect_range", "falses", "fill", "from_numpy", "ones", "trues", "zeros"]
