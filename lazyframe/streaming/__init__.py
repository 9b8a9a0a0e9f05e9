"""Verbs over streaming frames: a ``Table`` plan that needs no action also runs on ``readStream``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet") -> DataFrame:
    """Files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).format(form).load(path)


def write_stream(frame: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Runs ``plan`` on what there is now and appends the result to ``path``, once for each input file."""
    return plan(frame).writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
