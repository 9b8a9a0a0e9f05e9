"""PNG and JPEG files as arrays, decoded in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.array import NDArray


def _paths(source) -> list[str]:
    """A path, a list of paths, (items, f) or (object, items, f) with ``f`` giving a path."""
    if isinstance(source, str):
        return [source]
    if isinstance(source, tuple) and len(source) == 2 and isinstance(source[1], Callable):
        return [source[1](x) for x in source[0]]
    if isinstance(source, tuple) and len(source) == 3 and isinstance(source[2], Callable):
        return [source[2](source[0], x) for x in source[1]]
    return list(source)


def read_images(spark: SparkSession, source, add_channelview: bool = False) -> NDArray:
    """(image, row, column) of RGB structs, or with ``add_channelview`` (image, channel, row, column) of numbers from 0 to 1.

    Images are numbered in order of their paths and must be of one size.
    """
    d = spark.read.format("image").option("dropInvalid", False).load(_paths(source)).select("image.*")
    facts = d.agg(F.count("*"), F.min("height"), F.max("height"), F.min("width"), F.max("width")).first()
    n, tall, tallest, wide, widest = facts
    if n == 0:
        raise FileNotFoundError(f"no image in {source!r}")
    if tall != tallest or wide != widest:
        raise ValueError("the images differ in size")
    names = [r[0] for r in d.select("origin").orderBy("origin").collect()]
    order = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "origin string, i1 long")

    def run(frames):
        import numpy as np
        import pandas as pd

        for p in frames:
            for r in p.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, :3]
                x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, ::-1]  # stored blue first
                i, j = np.indices(x.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"i1": r.i1, "i2": i, "i3": j, "r": x[:, :, 0].ravel() / 255, "g": x[:, :, 1].ravel() / 255, "b": x[:, :, 2].ravel() / 255})

    pixels = d.join(F.broadcast(order), "origin").mapInPandas(run, "i1 long, i2 long, i3 long, r double, g double, b double")
    if not add_channelview:
        return NDArray(pixels.select("i1", "i2", "i3", F.struct("r", "g", "b").alias("value")), (n, tall, wide))
    channels = pixels.select("i1", F.posexplode(F.array("r", "g", "b")).alias("c", "value"), "i2", "i3")
    return NDArray(channels.select("i1", F.col("c").cast("long").alias("i2"), F.col("i2").alias("i3"), F.col("i3").alias("i4"), "value"), (n, 3, tall, wide))


read_png = read_jpg = read_images
