"""Samples of exact size, and the cache of what is known about a dataset's path."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import current
from .kept import free


def sample_size(rows: int, rate: int | None = None) -> int:
    """All rows up to the exact length, else one in ``rate``, rounded up."""
    c = current()
    return rows if rows <= c.max_exact_sample_length else math.ceil(rows / (rate or c.sample_rate))


def take_sample(df: DataFrame, rows: int | None = None, rate: int | None = None, shuffled: bool = False) -> tuple[DataFrame, int]:
    """(sample, rate): exactly ``sample_size`` rows; rate 1 if they are all.

    Rows of the least seeded hash of their content, so it doesn't depend on the layout;
    ``shuffled`` says that the order is random already, and the first rows are taken.
    """
    c = current()
    rows = df.count() if rows is None else rows
    n = sample_size(rows, rate)
    if n >= rows:
        return df, 1
    if shuffled:
        return df.limit(n), rate or c.sample_rate
    plain = [x for x, t in df.dtypes if not t.startswith("map")]
    name = free(df.columns, "hash")[0]
    d = df.withColumn(name, F.xxhash64(*[F.col(f"`{x}`") for x in plain], F.lit(c.seed)))
    # all rows below a threshold that surely isn't too high, and of those just above it as many as are missing
    off = 6 * math.sqrt(n) / rows
    low, high = (int(-(1 << 63) + min(max(n / rows + s, 0.0), 1.0) * ((1 << 64) - 1)) for s in (-off, off))
    below, between = F.col(name) < low, (F.col(name) >= low) & (F.col(name) <= high)
    surely, more = (x or 0 for x in d.agg(F.sum(below.cast("long")), F.sum(between.cast("long"))).first())
    if surely > n or surely + more < n:  # very many equal rows share their hashes
        return d.orderBy(name, F.rand(c.seed)).limit(n).drop(name), rate or c.sample_rate
    return d.where(below).unionByName(d.where(between).orderBy(name, F.rand(c.seed)).limit(n - surely)).drop(name), rate or c.sample_rate


@dataclass
class Known:
    """Facts about a path: its row count and sample; either may be out of date."""

    rows: int | None = None
    sample: DataFrame | None = None
    rate: int = 1
    metadata_stale: bool = False
    sample_stale: bool = False


class Cache:
    """By path. ``*_invalid`` ignores what is kept, ``invalidate_*`` marks it out of date after use."""

    def __init__(self):
        self.known: dict[str, Known] = {}

    def lookup(self, path: str, df: DataFrame, *, shuffled=False, metadata_invalid=False, sample_invalid=False, invalidate_metadata=False, invalidate_sample=False) -> Known:
        k = self.known.setdefault(path, Known())
        if k.rows is None or metadata_invalid or k.metadata_stale:
            k.rows, k.metadata_stale = df.count(), False
            k.sample = None
        if k.sample is None or sample_invalid or k.sample_stale:
            k.sample, k.rate = take_sample(df, k.rows, shuffled=shuffled)
            k.sample_stale = False
        now = Known(k.rows, k.sample, k.rate)
        k.metadata_stale |= invalidate_metadata
        k.sample_stale |= invalidate_sample
        return now

    def forget(self, path: str | None = None, *, metadata: bool = True, sample: bool = True) -> None:
        for at, k in self.known.items():
            if path is None or at == path:
                k.metadata_stale |= metadata
                k.sample_stale |= sample


CACHE = Cache()


def sample_stats(df: DataFrame, column: str) -> dict:
    """min, max, distinct values and deciles of a sample's column; advice only."""
    r = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.count_distinct(column).alias("groups")).first()
    numeric = dict(df.dtypes)[column] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    return r.asDict() | {"divisions": df.approxQuantile(column, [k / 10 for k in range(11)], 0.01) if numeric else None}
