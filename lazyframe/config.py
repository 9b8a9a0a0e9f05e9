"""Settings of the library, and the session as a context manager."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """``sample_rate``: one row in so many; tables of up to ``max_exact_sample_length`` rows are their own sample."""

    sample_rate: int = 16
    max_exact_sample_length: int = 1024
    seed: int = 42


_NOW = Config()


def current() -> Config:
    return _NOW


@contextmanager
def session(spark: SparkSession | None = None, **changes):
    """Runs a block under changed settings and yields its Spark session."""
    global _NOW
    before, _NOW = _NOW, replace(_NOW, **changes)
    try:
        yield spark or SparkSession.builder.getOrCreate()
    finally:
        _NOW = before
