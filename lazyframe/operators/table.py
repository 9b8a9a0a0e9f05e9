"""Tables: a Spark plan and, beside it, the same plan over a sample of the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import Opaque, Row, call, quoted
from ..functions.selectors import resolve
from ..plans.kept import free
from ..plans.sampling import CACHE, take_sample

FORMATS = ("csv", "parquet", "arrow")


class Table:
    """An immutable plan behind a handle; verbs return new tables, ``t[:, name] = v`` rebinds this one."""

    def __init__(self, df: DataFrame, sample: DataFrame | None = None, rate: int = 1, rows: int | None = None):
        self._df, self._sample, self._rate, self._rows, self._memo = df, sample, rate, rows, None

    # -- properties ------------------------------------------------------------------------------------
    @classmethod
    def from_local(cls, spark: SparkSession, data) -> Table:
        return cls(spark.createDataFrame(data))

    @property
    def spark(self) -> DataFrame:
        """The plan."""
        return self._df

    @property
    def names(self) -> list[str]:
        return self._df.columns

    propertynames = names

    def names_of(self, selector) -> list[str]:
        return resolve(self.names, selector)

    @property
    def ncol(self) -> int:
        return len(self._df.columns)

    @property
    def nrow(self) -> int:
        if self._rows is None:
            self._rows = self._df.count()
        return self._rows

    @property
    def size(self) -> tuple[int, int]:
        return self.nrow, self.ncol

    ndims = 2

    def copy(self) -> Table:
        return Table(self._df, self._sample, self._rate, self._rows)

    deepcopy = copy

    def sample(self) -> DataFrame:
        """This plan over the sources' samples; drawn here where there are none."""
        if self._sample is None:
            self._sample, self._rate = take_sample(self._df, self._rows)
        return self._sample

    @property
    def rate(self) -> int:
        self.sample()
        return self._rate

    def _then(self, f: Callable[[DataFrame], DataFrame], rows: int | None = None) -> Table:
        return Table(f(self._df), None if self._sample is None else f(self._sample), self._rate, rows)

    def pipe(self, f: Callable[[DataFrame], DataFrame]) -> Table:
        """Any function of frames, on the plan and on its sample."""
        return self._then(f)

    # -- filters and missing values ---------------------------------------------------------------------
    def filter(self, predicate, *columns, view: bool = False) -> Table:
        """``predicate`` of a row, or of ``columns``; a Column is taken as it is."""
        if view:
            raise ValueError("view=True isn't supported")
        if isinstance(predicate, Column):
            condition = predicate
        elif columns:
            condition = call(predicate, [F.col(quoted(c)) for part in columns for c in self.names_of(part)])
        elif isinstance(predicate, Opaque):
            names = self.names
            run = Opaque(lambda *v: predicate.f(dict(zip(names, v, strict=True))), "boolean")
            condition = call(run, [F.col(quoted(c)) for c in names])
        else:
            condition = predicate(Row(self.names))
        return self._then(lambda d: d.where(condition))

    def dropmissing(self, selector=None, view: bool = False) -> Table:
        """Rows without NULL in the columns; NaN is a number and stays."""
        if view:
            raise ValueError("view=True isn't supported")
        names = self.names_of(selector)
        return self._then(lambda d: d.where(" and ".join(f"{quoted(c)} is not null" for c in names) or "true"))

    def allowmissing(self) -> Table:
        """Every column may hold NULL, by schema."""
        return self._then(lambda d: d.select([F.when(F.lit(True), F.col(quoted(c))).alias(c) for c in d.columns]), self._rows)

    def disallowmissing(self) -> Table:
        """Fails when computed if a value is missing; else the columns are free of NULL by schema."""
        return self._then(lambda d: d.select([F.coalesce(F.col(quoted(c)), F.raise_error(F.lit(f"missing value in {c}")).cast(t)).alias(c) for c, t in d.dtypes]), self._rows)

    def _ranked(self, d: DataFrame, names: list[str], order: str | None) -> tuple[DataFrame, str]:
        """With a column, whose name comes along: the number of the row among those equal in ``names``, in the given or the read order."""
        nth, rid = free(d.columns, "nth", "rid")
        if order is None:
            d, order = d.withColumn(rid, F.monotonically_increasing_id()), rid
        return d.withColumn(nth, F.row_number().over(W.partitionBy(*map(quoted, names)).orderBy(quoted(order)))), quoted(nth)

    def unique(self, selector=None, order: str | None = None, view: bool = False) -> Table:
        """Distinct rows, or the first of the rows that are equal in the columns."""
        names = self._plain(selector, view)
        if names == self.names:
            return self._then(lambda d: d.distinct())

        def first(d: DataFrame) -> DataFrame:
            d, nth = self._ranked(d, names, order)
            return d.where(f"{nth} = 1").select(*map(quoted, self.names))

        return self._then(first)

    def nonunique(self, selector=None, order: str | None = None) -> Table:
        """The table with a column ``nonunique``: true for the second and later of equal rows."""
        names = self._plain(selector, False)

        def flagged(d: DataFrame) -> DataFrame:
            d, nth = self._ranked(d, names, order)
            return d.select(*map(quoted, self.names), (F.col(nth) > 1).alias("nonunique"))

        return self._then(flagged)

    def _plain(self, selector, view: bool) -> list[str]:
        if view:
            raise ValueError("view=True isn't supported")
        if callable(selector) or isinstance(selector, tuple):
            raise ValueError("a function or a pair selects no columns here")
        return self.names_of(selector)

    # -- columns ---------------------------------------------------------------------------------------
    def __getitem__(self, key):
        """``t[:, selector]``: a vector for one name or number, else a table; ``t[mask, selector]`` keeps rows."""
        rows, cols = key if isinstance(key, tuple) and len(key) == 2 else (None, None)
        from .array import NDArray

        if isinstance(rows, NDArray):
            if rows.table is not self:
                raise ValueError("the mask belongs to another table; filter by its own columns or zip by position first")
            kept = self.filter(rows.column)
            return kept[:, cols]
        if not (isinstance(rows, slice) and rows == slice(None)):
            raise ValueError("rows are selected by : or by a mask of this table")
        if isinstance(cols, (str, int)):
            return NDArray.of_column(self, resolve(self.names, cols)[0])
        names = self.names_of(cols)
        return self._then(lambda d: d.select(*map(quoted, names)), self._rows)

    def select(self, *selectors) -> Table:
        return self[:, list(selectors)]

    def with_columns(self, **columns) -> Table:
        """Added or replaced columns: Columns, lambdas of the row, vectors of this table, or values."""
        from .array import NDArray

        made = {}
        for name, v in columns.items():
            if isinstance(v, NDArray):
                if v.table is not self:
                    raise ValueError("the vector belongs to another table")
                v = v.column
            elif callable(v) and not isinstance(v, Column):
                v = v(Row(self.names))
            made[name] = v if isinstance(v, Column) else F.lit(v)
        return self._then(lambda d: d.withColumns(made), self._rows)

    def __setitem__(self, key, value) -> None:
        rows, cols = key
        if not (isinstance(rows, slice) and rows == slice(None)):
            raise ValueError("only all rows can be assigned")
        names = [cols] if isinstance(cols, str) else [x if isinstance(x, str) else self.names[x - 1] for x in ([cols] if isinstance(cols, int) else cols)]
        values = value if isinstance(value, (list, tuple)) else [value]
        if len(values) != len(names):
            raise ValueError("as many vectors as columns are needed")
        new = self.with_columns(**dict(zip(names, values, strict=True)))
        self.__dict__.update(new.__dict__)

    def rename(self, *pairs, **named) -> Table:
        """Pairs (old, new), old=new, or a function of every name."""
        if len(pairs) == 1 and callable(pairs[0]):
            changes = {c: pairs[0](c) for c in self.names}
        else:
            changes = dict(pairs) | named
        for old in changes:
            resolve(self.names, old)
        new = [changes.get(c, c) for c in self.names]
        if len(set(new)) < len(new):
            raise ValueError(f"names would repeat: {new}")
        return self._then(lambda d: d.toDF(*new), self._rows)

    # -- order, joins, groups ---------------------------------------------------------------------------
    def sort(self, selector=None, rev: bool = False) -> Table:
        """By the columns from left to right; a range exchange and local sorts."""
        names = self.names_of(selector)
        return self._then(lambda d: d.orderBy(*[F.col(quoted(c)).desc() if rev else F.col(quoted(c)) for c in names]), self._rows)

    def innerjoin(self, *others: Table, on, renamecols=None) -> Table:
        return innerjoin(self, *others, on=on, renamecols=renamecols)

    def groupby(self, selector, sort: bool = True):
        from .grouped import GroupedTable

        if not sort:
            raise ValueError("sort=False isn't supported")
        return GroupedTable(self, self.names_of(selector))

    # -- results ---------------------------------------------------------------------------------------
    def compute(self):
        """The rows as a pandas frame, kept with this handle."""
        if self._memo is None:
            self._memo = self._df.toPandas()
        return self._memo

    def compute_inplace(self) -> Table:
        """Computes on the cluster and keeps the rows there, on disk."""
        from pyspark import StorageLevel

        self._df = self._df.persist(StorageLevel.DISK_ONLY)
        self._rows = self._df.count()
        return self

    def destroy(self) -> None:
        self._df.unpersist()
        self._memo = None

    def write(self, path: str, form: str | None = None) -> None:
        from ..sources.tables import write_table

        write_table(self._df, path, form)
        CACHE.forget(path)

    def write_csv(self, path: str) -> None:
        self.write(path, "csv")

    def write_parquet(self, path: str) -> None:
        self.write(path, "parquet")

    def write_arrow(self, path: str) -> None:
        self.write(path, "arrow")


def join_keys(on) -> list[tuple[str, str]]:
    """``on``: a name, a pair (left, right), or a list that mixes both."""
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, tuple):
        return [on]
    return [x if isinstance(x, tuple) else (x, x) for x in on]


def innerjoin(*tables: Table, on, renamecols: tuple[Callable, Callable] | None = None) -> Table:
    """Equijoin of two or more tables from left to right; keys keep their left names, and NULL matches nothing.

    ``renamecols``: functions of the names of the left and the right columns that aren't
    keys. Spark picks broadcast or sort-merge by size, and splits skewed partitions.
    """
    if len(tables) < 2:
        raise ValueError("at least two tables are joined")
    keys = join_keys(on)

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        lefts, rights = [k for k, _ in keys], [k for _, k in keys]
        f, g = renamecols or (None, None)
        a = a.toDF(*[c if c in lefts or f is None else f(c) for c in a.columns])
        names = [c if c in rights or g is None else g(c) for c in b.columns]
        clash = {c for c in names if c in a.columns} - set(rights)
        if clash:
            raise ValueError(f"columns of both tables: {sorted(clash)}; use renamecols")
        b = b.toDF(*[f"_right_{c}" if c in rights else c for c in names])
        condition = [a[quoted(x)] == b[quoted(f"_right_{y}")] for x, y in keys]
        return a.join(b, condition, "inner").drop(*[f"_right_{c}" for c in rights])

    df = tables[0].spark
    for t in tables[1:]:
        df = two(df, t.spark)
    if all(t._sample is not None for t in tables):
        s, rate = tables[0]._sample, tables[0]._rate
        for t in tables[1:]:
            s, rate = two(s, t._sample), rate * t._rate
        return Table(df, s, rate)
    return Table(df)
