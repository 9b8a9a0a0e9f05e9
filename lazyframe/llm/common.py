"""What the operators of this subpackage share: the shared folder, Arrow helpers, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a session on one machine, as in tests, gets one; on a
    cluster that is an error, since a folder of the driver's machine would lose rows.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lazyframe-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path of the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, read: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Where its rows are packed, ``read`` makes a table's rows of them; as stored they are in ``stored``.
    """
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.options(**options).parquet(at)
    stored = spark.read.schema(df.schema).parquet(at)
    table = read(stored) if read else stored
    table.written_at, table.stored = at, stored
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing lazy may still read them."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession, df: DataFrame, factor: float = 1.0) -> int:
    """Shuffle partitions for work that grows with ``df``: never fewer than its input splits."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(df.rdd.getNumPartitions() * factor), 1)


def with_texts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(``docs``, the place of its texts as strings, its own columns): a text column of another type gets a string column beside it."""
    if dict(docs.dtypes)["text"] == "string":
        return docs, docs.columns.index("text"), len(docs.columns)
    return docs.withColumn(free(docs, "text_")[0], F.col("text").cast("string")), len(docs.columns), len(docs.columns)


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null read as the empty text."""
    return [x or "" for x in column.to_pylist()]


def pieces(batches, rows: int):
    """The same rows in batches of ``rows`` at most, so that what a worker makes of a batch stays small.

    Between batches Arrow gives back what it holds free, as workers live on with what they have taken.
    """
    for x in batches:
        for at in range(0, x.num_rows, rows):
            yield x.slice(at, rows)
        pa.default_memory_pool().release_unused()


_LEFT: dict[str, Callable] = {}


def turn_to(name: str, forget: Callable) -> None:
    """A worker that turns to another operator lets go of what the last one remembered; ``forget`` does that for this one."""
    if name not in _LEFT:
        for clear in _LEFT.values():
            clear()
        _LEFT.clear()
        gc.collect()  # what was remembered may hold itself in circles
        give_back()
    _LEFT[name] = forget


def nothing() -> None:
    """Nothing is remembered from task to task."""


def give_back() -> None:
    """Memory that is free but held goes back to the system, as a worker waits long between two tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def work(name: str, forget: Callable = nothing, ended: Callable = nothing):
    """Wraps a function on batches for ``mapInArrow``: as its task begins the worker turns to operator ``name``,
    and as it ends the worker calls ``ended`` and gives back what the task has left free."""

    def of(run):
        def running(batches):
            turn_to(name, forget)
            try:
                yield from run(batches)
            finally:
                ended()
                give_back()

        return running

    return of


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def crc_of_id(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a-b, for the nodes that aren't least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


@work("components")
def _forest(batches):
    parts = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for at in range(0, len(a), 1 << 20):  # blocks bound the memory; a forest of each keeps all components
            yield batch(schema, *local_forest(a[at : at + (1 << 20)], b[at : at + (1 << 20)]))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long): root is the component's least node.

    Each partition first keeps a spanning forest of its edges; then the large-star and
    small-star steps of Kiveris et al. (2014) alternate until nothing moves, each round
    written to the shared folder. A hub's neighbours are never gathered: a minimum per
    node (combined before the shuffle) is joined back, and skewed joins are split by AQE.
    """
    spark = edges.sparkSession
    e = last = written(edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if e.isEmpty():
        return spark.createDataFrame([], "node long, root long")

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs: (u, v) with u > v. Larger neighbours, or the node and its smaller ones, are hung on the least."""
        if larger:
            least = pairs.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
            up = pairs.select(F.col("v").alias("x"), F.col("u").alias("y"))
            joined = up.join(least, "x", "left").select("y", F.coalesce("m", "x").alias("m"))
            return joined.union(least.select(F.col("x").alias("y"), "m")).where("y > m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u").select(F.explode(F.array("u", "v")).alias("y"), "m")
        return joined.where("y > m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()

    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most_rounds):
        new = written(star(star(e, True), False), "edges")
        removed(last)
        last = new
        # every node hangs on one other, and none that others hang on hangs itself: stars, so done
        n, distinct = new.agg(F.count("*"), F.count_distinct("u")).first()
        if n == distinct and new.select("u").intersect(new.select("v")).isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


SIEVE = 26  # a sieve has 2**26 bits


def sieved(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a boolean column last: false where the long ``column`` isn't in the one column of ``ids``, true where it
    may be. Null is in nothing.

    However many ids there are, 8 MB are broadcast: a bit for each value of their hash.
    """
    bits = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(1 << SIEVE))
    sieve = ids.dropna().select(F.shiftright(bits, 15).alias("bucket"), bits.bitwiseAND((1 << 15) - 1).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    bucket, its, may = free(rows, "bucket", "bits", "may")
    sieve = written(sieve.select(F.col("bucket").alias(bucket), F.col("bits").alias(its)), "sieve")
    value = F.col(column).cast("long")
    at = F.pmod(F.xxhash64(value), F.lit(1 << SIEVE))
    byte = F.conv(F.hex(F.substring(its, (F.shiftright(at, 3).bitwiseAND((1 << 12) - 1) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    there = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False)) & value.isNotNull()
    return rows.withColumn(bucket, F.shiftright(at, 15)).join(F.broadcast(sieve), bucket, "left").withColumn(may, there).select(*rows.columns, may)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
