"""Grouped tables: a parent and its keys, and what can be asked of the groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.functions import PandasUDFType

from ..functions.expr import AGGREGATES, Captured, Opaque, call, label, over, quoted
from ..functions.selectors import resolve
from ..functions.vectors import Placed, traced
from ..plans.kept import free


class GroupedTable:
    """A lazy view: it can't be computed or copied, only combined, selected from, transformed or filtered."""

    ndims = 1

    def __init__(self, table, keys: list[str]):
        self.table, self.keys = table, keys

    groupcols = property(lambda self: list(self.keys))
    valuecols = property(lambda self: [c for c in self.table.names if c not in self.keys])

    def __len__(self) -> int:
        return self.table.spark.select(*map(quoted, self.keys)).distinct().count()

    @property
    def size(self) -> tuple[int]:
        return (len(self),)

    def compute(self):
        raise TypeError("a grouped table is a view; combine it first")

    copy = deepcopy = compute

    def _outputs(self, args, renamecols: bool) -> list[tuple[str, object, list[str]]]:
        """(name, function or None for the column itself, its columns) of each argument."""
        out = []
        for a in args:
            if isinstance(a, list):
                out += self._outputs(a, renamecols)
                continue
            if isinstance(a, tuple):
                columns, f, *name = a
                names = resolve(self.table.names, columns)
                f = AGGREGATES.get(f, f) if isinstance(f, str) else f
                if f is not None and not callable(f) and not isinstance(f, Opaque):
                    raise TypeError(f"{f!r} is no function")
                out.append((name[0] if name else "_".join(names) + f"_{label(f)}" if renamecols else "_".join(names), f, names))
            elif isinstance(a, str) and a in AGGREGATES and a not in self.table.names or callable(a):
                f = AGGREGATES[a] if isinstance(a, str) else a
                out.append((label(f), f, []))
            else:
                out += [(c, None, [c]) for c in resolve(self.table.names, a)]
        return out

    @staticmethod
    def _no(**flags) -> None:
        for name, (value, wanted) in flags.items():
            if value != wanted:
                raise ValueError(f"{name}={value} isn't supported")

    def _columns(self, args, renamecols: bool) -> list[tuple[str, Column]]:
        return [(name, F.col(quoted(names[0])) if f is None else call(f, [F.col(quoted(c)) for c in names])) for name, f, names in self._outputs(args, renamecols)]

    def combine(self, *args, renamecols: bool = True, keepkeys: bool = True, ungroup: bool = True, propagate_missing: bool = False):
        """One row a group: partial aggregates before the shuffle, final ones after it. Functions marked ``by_row``
        with ``many`` give a row for each of their results; shorter results and single values are repeated or end in NULL."""
        self._no(keepkeys=(keepkeys, True), ungroup=(ungroup, True))
        outputs = self._outputs(args, renamecols)
        if any(isinstance(f, Opaque) and f.many for _, f, _ in outputs):
            return self._many(outputs, propagate_missing)
        if any(isinstance(f, Opaque) for _, f, _ in outputs):
            return self._opaque(outputs)
        with over(None, propagate_missing):
            made = [c.alias(n) for n, c in self._columns(args, renamecols)]
        return self.table._then(lambda d: d.groupBy(*map(quoted, self.keys)).agg(*made))

    def _opaque(self, outputs):
        """Functions of whole groups, as grouped pandas aggregates; a group must fit a worker's memory."""
        native, opaque = [], []
        for name, f, names in outputs:
            columns = [F.col(quoted(c)) for c in names]
            if not isinstance(f, Opaque):
                native.append(call(f, columns).alias(name))
            else:
                opaque.append(F.pandas_udf(lambda *series, f=f.f: f(*series), f.returns, PandasUDFType.GROUPED_AGG)(*columns).alias(name))

        def run(d):
            keys = free(self.table.names + [n for n, _, _ in outputs], *[f"key_{c}" for c in self.keys])
            out = d.groupBy(*map(quoted, self.keys)).agg(*opaque)
            if native:  # Spark doesn't mix both kinds
                other = d.groupBy(*[F.col(quoted(c)).alias(k) for c, k in zip(self.keys, keys, strict=True)]).agg(*native)
                out = out.join(other, [F.col(quoted(c)).eqNullSafe(F.col(quoted(k))) for c, k in zip(self.keys, keys, strict=True)])
            return out.select(*map(quoted, self.keys), *[quoted(n) for n, _, _ in outputs])

        return self.table._then(run)

    def apply(self, f, schema: str):
        """``f(pandas frame) -> pandas frame`` of each group, for results of any number of rows."""
        return self.table._then(lambda d: d.groupBy(*map(quoted, self.keys)).applyInPandas(f, schema))

    def _many(self, outputs, propagate: bool):
        """Results of any number of rows; a group's columns that are asked for must fit a worker's memory."""
        with over(None, propagate):
            whole = {n: call(f, [F.col(quoted(c)) for c in names]) for n, f, names in outputs if f is not None and not isinstance(f, Opaque)}
        opaque = {n: (f, names) for n, f, names in outputs if isinstance(f, Opaque)}

        def run(d: DataFrame) -> DataFrame:
            keys = [quoted(c) for c in self.keys]
            kinds = dict(d.dtypes) | (dict(d.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()]).dtypes) if whole else {})
            if whole:
                d = self._joined(d, whole)
            kinds |= {n: f.returns for n, (f, _) in opaque.items()}
            order = [*self.keys, *[n for n, _, _ in outputs if n not in self.keys]]

            def group(frame):
                import pandas as pd

                made = {n: f.f(*[frame[c].reset_index(drop=True) for c in names]) if names else f.f(len(frame)) for n, (f, names) in opaque.items()}
                size = max([len(v) for n, v in made.items() if opaque[n][0].many], default=1)
                many = {n: pd.Series(list(v) if opaque[n][0].many else [v] * size).reindex(range(size)) for n, v in made.items()}
                return pd.DataFrame({n: many[n] if n in many else pd.Series([frame[n].iloc[0]] * size) for n in order})[order]

            needed = dict.fromkeys([*self.keys, *[n for n in order if n not in opaque], *[c for _, names in opaque.values() for c in names]])
            return d.select(*map(quoted, needed)).groupBy(*keys).applyInPandas(group, ", ".join(f"{quoted(n)} {kinds[n]}" for n in order))

        return self.table._then(run)

    def _joined(self, d: DataFrame, aggregates: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
        """``d`` with aggregates of each row's group, computed from ``source``, which has the same rows. Partial sums go before the groups' exchange; Spark broadcasts the
        groups' table if it turns out small, and else splits the rows of a key that very many have."""
        keys = free([*d.columns, *aggregates], *[f"group_{c}" for c in self.keys])
        groups = (d if source is None else source).groupBy(*[F.col(quoted(c)).alias(k) for c, k in zip(self.keys, keys, strict=True)]).agg(*[c.alias(n) for n, c in aggregates.items()])
        on = [F.col(quoted(c)).eqNullSafe(F.col(quoted(k))) for c, k in zip(self.keys, keys, strict=True)]
        return d.join(groups, on, "left").drop(*keys)

    def _placed(self, d: DataFrame, name: str, what: Placed, source: DataFrame) -> DataFrame:
        """``d`` with the median of each row's group or the rank of its value there, computed from ``source``.

        Each group's distinct values are counted, and dealt to tasks by the group and the 1024th of its span in which
        they lie, so a large group isn't sorted in one task unless its values crowd in one such part.
        """
        *keys, value, x, n, low, high, part, less, rows = free([*d.columns, name], *[f"group_{c}" for c in self.keys], "value", "x", "n", "low", "high", "part", "less", "rows")
        mine, row = [F.col(quoted(k)) for k in keys], [F.col(quoted(c)) for c in self.keys]

        def meet(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
            here = free([*a.columns, *b.columns], *columns)
            b = b.withColumnsRenamed(dict(zip(columns, here, strict=True)))
            return a.join(b, [F.col(quoted(p)).eqNullSafe(F.col(quoted(q))) for p, q in zip(columns, here, strict=True)]).drop(*here)

        d = d.withColumn(value, what.value)
        counts = source.withColumn(value, what.value).where(F.col(value).isNotNull()).groupBy(*[c.alias(k) for c, k in zip(row, keys, strict=True)], F.col(value).alias(x)).agg(F.count(F.lit(1)).alias(n))
        counts = meet(counts, counts.groupBy(*mine).agg(F.min(x).alias(low), F.max(x).alias(high)), keys)
        span = F.col(high) - F.col(low)
        share = F.when((span > 0) & (span < float("inf")), F.floor((F.col(x) - F.col(low)) / F.when(span > 0, span) * 1024)).otherwise(0)
        counts = counts.select(*mine, x, F.lit(1).cast("long").alias(n) if what.how == "dense" else n, share.cast("long").alias(part))
        up = what.ascending
        before = W.partitionBy(*mine, part).orderBy(F.col(x) if up else F.col(x).desc()).rowsBetween(W.unboundedPreceding, -1)
        earlier = W.partitionBy(*mine).orderBy(F.col(part) if up else F.col(part).desc()).rowsBetween(W.unboundedPreceding, -1)
        parts = counts.groupBy(*mine, part).agg(F.sum(n).alias(rows))
        parts = parts.select(*mine, part, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(rows))
        counts = meet(counts.withColumn(less, F.coalesce(F.sum(n).over(before), F.lit(0))), parts, [*keys, part])
        counts = counts.select(*mine, x, n, (F.col(less) + F.col(rows)).alias(less))
        on = [a.eqNullSafe(b) for a, b in zip(row, mine, strict=True)]
        if what.how == "median":
            counts = meet(counts, counts.groupBy(*mine).agg(F.sum(n).alias(rows)), keys)
            lower, upper = (F.max(F.when(F.col(less) <= F.floor((F.col(rows) - back) / 2), F.col(x))) for back in (1, 0))
            return d.join(counts.groupBy(*mine).agg(((lower + upper) / 2).alias(name)), on, "left").drop(*keys, value)
        rank = {"average": F.col(less) + (F.col(n) + 1) / 2, "max": F.col(less) + F.col(n)}.get(what.how, F.col(less) + 1)
        return d.join(counts.select(*mine, x, rank.cast("double").alias(name)), [*on, F.col(value) == F.col(x)], "left").drop(*keys, value, x)

    def _vectors(self, d: DataFrame, opaque: dict[str, tuple[Opaque, list[str]]]) -> DataFrame:
        """``d`` with what functions give of each group's vectors. A worker holds these, and the frames of the group in a file."""
        kinds = d.dtypes + [(n, f.returns) for n, (f, _) in opaque.items()]
        needed = list(dict.fromkeys(c for _, columns in opaque.values() for c in columns))

        import pandas as pd

        def run(frames):
            import pickle
            import tempfile

            with tempfile.TemporaryFile() as file:
                parts, sizes = [], []
                for frame in frames:
                    pickle.dump(frame, file, pickle.HIGHEST_PROTOCOL)
                    parts.append(frame[needed].copy())
                    sizes.append(len(frame))
                whole = pd.concat(parts, ignore_index=True)
                del parts
                made = {n: f.f(*[whole[c] for c in columns]) if columns else f.f(len(whole)) for n, (f, columns) in opaque.items()}
                made = pd.DataFrame(index=whole.index).assign(**made)
                del whole
                file.seek(0)
                at = 0
                for size in sizes:
                    frame = pickle.load(file)
                    yield frame.assign(**{n: made[n].iloc[at : at + size].set_axis(frame.index) for n in opaque})
                    at += size

        run.__annotations__ = {"frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
        return d.groupBy(*map(quoted, self.keys)).applyInPandas(run, ", ".join(f"{quoted(c)} {t}" for c, t in kinds))

    def _by_group(self, args, renamecols: bool, propagate: bool, finish):
        """``finish(frame, {output: column})`` on the rows with what their groups give."""
        if not self.keys:
            raise ValueError("groups need a key")
        outputs, taken = self._outputs(args, renamecols), self.table.names
        group = Captured([*taken, *[n for n, _, _ in outputs]])
        with over(group, propagate):
            made = {n: F.col(quoted(names[0])) if f is None else call(f, [F.col(quoted(c)) for c in names]) for n, f, names in outputs if not isinstance(f, Opaque)}
        opaque = {n: (f, names) for n, f, names in outputs if isinstance(f, Opaque)}
        if any(f.many for f, _ in opaque.values()):
            raise ValueError("a function of any number of results is for combine")
        kind = dict(self.table.spark.dtypes)
        for n, (f, names) in list(opaque.items()):
            if (c := traced(f, [F.col(quoted(c)) for c in names], [kind[c] for c in names], group)) is not None:
                made[n] = c
                del opaque[n]
        temp = dict(zip(opaque, free([*taken, *group.made], *[f"vector{k}" for k in range(len(opaque))]), strict=True))

        def run(d: DataFrame) -> DataFrame:
            names = d.columns
            for level in sorted(set(group.level.values())):
                now, source = {n: c for n, c in group.made.items() if group.level[n] == level}, d
                for n, c in now.items():
                    if isinstance(c, Placed):
                        d = self._placed(d, n, c, source)
                if whole := {n: c for n, c in now.items() if not isinstance(c, Placed)}:
                    d = self._joined(d, whole, source)
            if opaque:
                d = self._vectors(d, {temp[n]: x for n, x in opaque.items()})
            return finish(d, names, {n: F.col(quoted(temp[n])) if n in temp else made[n] for n, _, _ in outputs})

        return run

    def select(self, *args, renamecols: bool = True, keepkeys: bool = True, ungroup: bool = True, copycols: bool = True, propagate_missing: bool = False):
        """Keys and the chosen or derived columns; as many rows as before."""
        self._no(keepkeys=(keepkeys, True), ungroup=(ungroup, True), copycols=(copycols, True))

        def finish(d, _, made):
            return d.select(*map(quoted, self.keys), *[c.alias(n) for n, c in made.items() if n not in self.keys])

        return self.table._then(self._by_group(args, renamecols, propagate_missing, finish), self.table._rows)

    def transform(self, *args, renamecols: bool = True, keepkeys: bool = True, ungroup: bool = True, copycols: bool = True, propagate_missing: bool = False):
        """All columns and the derived ones."""
        self._no(keepkeys=(keepkeys, True), ungroup=(ungroup, True), copycols=(copycols, True))

        def finish(d, names, made):
            return d.select(*[made[c].alias(c) if c in made else F.col(quoted(c)) for c in names], *[c.alias(n) for n, c in made.items() if n not in names])

        return self.table._then(self._by_group(args, renamecols, propagate_missing, finish), self.table._rows)

    def subset(self, *args, ungroup: bool = True, copycols: bool = True, propagate_missing: bool = False):
        """The rows whose group-aware conditions all hold; a missing condition doesn't."""
        self._no(ungroup=(ungroup, True), copycols=(copycols, True))

        def finish(d, names, made):
            for c in made.values():
                d = d.where(c)
            return d.select(*map(quoted, names))

        return self.table._then(self._by_group(args, True, propagate_missing, finish))
