"""Code run once, or once a worker with collectives."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Worker:
    """What distributed code sees: its number, how many there are, and collectives over JSON values."""

    def __init__(self, context):
        self._context = context
        self.number, self.count = context.partitionId(), len(context.getTaskInfos())

    def sync_across(self) -> None:
        self._context.barrier()

    def gather_across(self, value) -> list:
        return [json.loads(x) for x in self._context.allGather(json.dumps(value))]

    def reduce_across(self, f, value):
        first, *rest = self.gather_across(value)
        for x in rest:
            first = f(first, x)
        return first

    def split_across(self, n: int) -> range:
        """This worker's part of range(n)."""
        return range(n * self.number // self.count, n * (self.number + 1) // self.count)


def offloaded(spark: SparkSession, f, *args, distributed: bool = False, workers: int = 2):
    """``f(*args)`` in one task, or ``f(worker, *args)`` in ``workers`` tasks at once; the first one's result."""
    sc = spark.sparkContext
    if not distributed:
        return sc.parallelize([0], 1).map(lambda _: f(*args)).collect()[0]

    def run(_):
        from pyspark import BarrierTaskContext

        yield f(Worker(BarrierTaskContext.get()), *args)

    return sc.parallelize(range(workers), workers).barrier().mapPartitions(run).collect()[0]
