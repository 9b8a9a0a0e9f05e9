"""CSV, Parquet and Arrow datasets: files or folders of parts, read lazily and written as folders."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.table import FORMATS, Table
from ..plans.sampling import CACHE


def _form(path: str) -> str:
    form = path.rstrip("/").rpartition(".")[2].lower()
    if form not in FORMATS:
        raise ValueError(f"{path!r} ends in none of {FORMATS}")
    return form


def _files(path: str) -> list[str]:
    """Of a file or folder that pyarrow's file systems reach, in order of name."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _open(path: str, at: str):
    from pyarrow import fs

    store = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    return store.open_input_file(at)


class _Batch(InputPartition):
    def __init__(self, at: str, number: int):
        self.at, self.number = at, number


class ArrowReader(DataSourceReader):
    """One partition a record batch."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out = []
        for at in _files(self.path):
            with _open(self.path, at) as f:
                out += [_Batch(at, k) for k in range(pa.ipc.open_file(f).num_record_batches)]
        return out or [_Batch("", -1)]

    def read(self, partition):
        if partition.number < 0:
            return
        with _open(self.path, partition.at) as f:
            yield pa.ipc.open_file(f).get_batch(partition.number)


class _Written(WriterCommitMessage):
    def __init__(self, at: str):
        self.at = at


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def write(self, batches):
        from pyarrow import fs
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        store.create_dir(at, recursive=True)
        name = f"{at}/part_{TaskContext.get().partitionId():05d}.arrow"
        schema = to_arrow_schema(self.schema)
        with store.open_output_stream(name) as out, pa.ipc.new_file(out, schema) as w:
            for b in batches:
                w.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, schema.types, strict=True)], schema=schema))
        return _Written(name)


class ArrowSource(DataSource):
    """``format("arrow_files")``: Arrow IPC files."""

    @classmethod
    def name(cls):
        return "arrow_files"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow file in {self.options['path']!r}")
        with _open(self.options["path"], files[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema, prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ArrowReader(self.options["path"])

    def writer(self, schema, overwrite):
        return ArrowWriter(self.options["path"], schema)


def _load(spark: SparkSession, path: str, form: str) -> DataFrame:
    if form == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if form == "parquet":
        return spark.read.parquet(path)
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_files").load(path)


def _read(spark: SparkSession, path: str, form: str, sampled: bool, **flags) -> Table:
    df = _load(spark, path, form)
    if not sampled:
        return Table(df)
    k = CACHE.lookup(path, df, **flags)
    return Table(df, k.sample, k.rate, k.rows)


def read_csv(spark: SparkSession, path: str, sampled: bool = False, **flags) -> Table:
    """With a header, types inferred. ``sampled`` draws the sample now; flags as in ``Cache.lookup``."""
    return _read(spark, path, "csv", sampled, **flags)


def read_parquet(spark: SparkSession, path: str, sampled: bool = False, **flags) -> Table:
    return _read(spark, path, "parquet", sampled, **flags)


def read_arrow(spark: SparkSession, path: str, sampled: bool = False, **flags) -> Table:
    return _read(spark, path, "arrow", sampled, **flags)


def read_table(spark: SparkSession, path: str, sampled: bool = False, **flags) -> Table:
    """By the ending of the file's or folder's name."""
    return _read(spark, path, _form(path), sampled, **flags)


def write_table(df: DataFrame, path: str, form: str | None = None) -> None:
    """A folder of parts in place of what was there, also if ``df`` reads it: written beside it, then swapped."""
    form = form or _form(path)
    if path.startswith(("http://", "https://")):
        raise ValueError("http paths can't be written")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    if form == "csv":
        df.write.csv(beside, header=True)
    elif form == "parquet":
        df.write.parquet(beside)
    elif form == "arrow":
        df.sparkSession.dataSource.register(ArrowSource)
        df.write.format("arrow_files").mode("append").save(beside)
    else:
        raise ValueError(f"{form!r} is none of {FORMATS}")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    store = new.getFileSystem(conf)
    store.delete(old, True)
    if not store.rename(new, old):
        raise OSError(f"{beside} couldn't be moved to {path}")
