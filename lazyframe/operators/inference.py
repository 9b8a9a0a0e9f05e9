"""ONNX models as callables on arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .array import NDArray

_SESSIONS: dict = {}


def _session(data: bytes):
    import onnxruntime as ort

    key = hash(data)
    if key not in _SESSIONS:
        o = ort.SessionOptions()
        o.intra_op_num_threads = o.inter_op_num_threads = 1
        _SESSIONS[key] = ort.InferenceSession(data, o, providers=["CPUExecutionProvider"])
    return _SESSIONS[key]


class Model:
    """One input and one output. The leading axis counts the cases; with ``dynamic_axis`` the model takes many at once."""

    def __init__(self, spark: SparkSession, data: bytes, dynamic_axis: bool = False):
        s = _session(data)
        if len(s.get_inputs()) != 1 or len(s.get_outputs()) != 1:
            raise ValueError("models have one input and one output")
        self.input, self.output, self.dynamic = s.get_inputs()[0].name, s.get_outputs()[0].name, dynamic_axis
        self.model = spark.sparkContext.broadcast(data)

    def __call__(self, inputs: dict[str, NDArray]) -> NDArray:
        if list(inputs) != [self.input]:
            raise ValueError(f"the input is {self.input!r}")
        a = inputs[self.input]
        inner = a.shape[1:]
        width, model, dynamic = math.prod(inner), self.model, self.dynamic
        place, step = F.lit(0).cast("long"), 1
        for axis, n in zip(reversed(a.axes[1:]), reversed(inner), strict=True):
            place, step = place + F.col(axis) * step, step * n
        cells = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("value").cast("float").alias("v")))), lambda x: x["v"])
        rows = a.spark.groupBy("i1").agg(cells.alias("cells"))

        def run(frames):
            s = _session(model.value)
            for p in frames:
                if not len(p):
                    continue
                x = np.array(p["cells"].tolist(), np.float32).reshape(-1, *inner)
                y = s.run(None, {s.get_inputs()[0].name: x})[0] if dynamic else np.stack([s.run(None, {s.get_inputs()[0].name: c})[0] for c in x])
                assert len(y) == len(p) and x.size == len(p) * width
                import pandas as pd

                yield pd.DataFrame({"i1": p["i1"], "cells": list(y.reshape(len(p), -1).astype(np.float32)), "shape": [list(y.shape[1:])] * len(p)})

        made = rows.mapInPandas(run, "i1 long, cells array<float>, shape array<long>").persist()
        shape = tuple(made.select("shape").first()[0])
        d, left, columns = made.select("i1", F.posexplode("cells").alias("p", "value")), math.prod(shape), []
        for k, n in enumerate(shape, 2):
            left //= n
            columns.append((F.floor(F.col("p") / left) % n).cast("long").alias(f"i{k}"))
        return NDArray(d.select("i1", *columns, "value"), (a.shape[0], *shape))


def load_inference(spark: SparkSession, path: str, dynamic_axis: bool = False) -> Model:
    """From any path that Spark reads."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return Model(spark, data, dynamic_axis)
