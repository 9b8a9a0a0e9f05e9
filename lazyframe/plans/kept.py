"""Tables kept in the folder that driver and executors share, for results that two passes must agree on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` as written to ``spark.checkpoint.dir`` and read again. Only a session on one machine may do without that setting."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lazyframe-kept-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that aren't among ``taken``."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(``df`` with its rows numbered from 0 in the order in which its plan reads them, how many there are).

    The rows are kept first, with the number of their task and their place in it, so the
    counts of the tasks (a number each, sent back as a broadcast table) fit the rows whatever
    a second run would do.
    """
    part, place = free([*df.columns, name], "part", "place")
    d = kept(df.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, at = [], 0
    for p, n in d.groupBy(part).count().orderBy(part).collect():
        starts.append((p, at))
        at += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} int, {name} long"))
    return d.join(first, part).select(*[f"`{c}`" for c in df.columns], (F.col(name) + F.col(place)).alias(name)), at
