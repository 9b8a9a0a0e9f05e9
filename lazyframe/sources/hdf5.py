"""HDF5 datasets as arrays; needs the h5py library where it runs."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.array import NDArray


def split_path(path: str) -> tuple[str, str]:
    """"a/b.h5/GROUP/SET" is the set "GROUP/SET" of the file "a/b.h5"."""
    for ending in (".h5", ".hdf5"):
        at = path.find(ending + "/")
        if at >= 0:
            return path[: at + len(ending)], path[at + len(ending) + 1 :]
    raise ValueError(f"{path!r} names no dataset of an .h5 or .hdf5 file")


def read_hdf5(spark: SparkSession, path: str, rows_a_task: int = 1 << 16) -> NDArray:
    """Blocks along the first axis, a task each; the file must lie where all executors reach it."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the h5py library, which isn't installed") from e
    file, name = split_path(path)
    with h5py.File(file, "r") as f:
        shape, kind = f[name].shape, f[name].dtype.kind
    rows = max(1, rows_a_task // max(1, math.prod(shape[1:])))
    value = {"i": "long", "u": "long", "f": "double", "b": "boolean"}[kind]

    def run(frames):
        import numpy as np
        import pandas as pd

        for p in frames:
            for start in p["id"]:
                with h5py.File(file, "r") as f:
                    block = f[name][start : start + rows]
                at = np.indices(block.shape).reshape(block.ndim, -1)
                at[0] += start
                yield pd.DataFrame({f"i{k + 1}": at[k] for k in range(block.ndim)} | {"value": block.ravel()})

    starts = spark.range(0, shape[0], rows).repartition(max(1, min(1024, -(-shape[0] // rows))), F.col("id"))
    return NDArray(starts.mapInPandas(run, ", ".join(f"i{k + 1} long" for k in range(len(shape))) + f", value {value}"), shape)
