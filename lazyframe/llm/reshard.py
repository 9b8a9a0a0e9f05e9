"""Resharding at minimum cost: which bytes of which old shard go to which new one.

Old sizes and new capacities make a transport problem, solved exactly by successive
shortest paths on a graph with one node a shard; staying costs nothing, a moved byte one
(or what the caller's cost says). Rows of an old shard are laid out in blocks, by size
class from large to small and then by hash, and the flows cut that line: whole blocks
go to one shard, and only a block that a cut passes is divided by its rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, partitions


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Integer flows i -> j that send all of ``supply`` within ``capacity`` at the least total cost."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than there is")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    high = [0.0] * (n + m)  # potentials: reduced costs stay non-negative, so Dijkstra holds
    while any(left):
        dist, via, heap = [float("inf")] * (n + m), [-1] * (n + m), []
        for i in range(n):
            if left[i]:
                dist[i] = 0.0
                heapq.heappush(heap, (0.0, i))
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                nexts = ((n + j, cost[u][j]) for j in range(m))
            else:
                nexts = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in nexts:
                new = d + max(0.0, c + high[u] - high[v])
                if new < dist[v] - 1e-12:
                    dist[v], via[v] = new, u
                    heapq.heappush(heap, (new, v))
        target = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j] + high[n + j], j))
        most = max((d for d in dist if d < float("inf")), default=0.0)
        for v in range(n + m):
            high[v] += min(dist[v], most)
        path, v = [n + target], n + target
        while via[v] >= 0:
            v = via[v]
            path.append(v)
        path.reverse()
        much = min(left[path[0]], room[target], *(flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n))
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += much
            else:
                flow[b][a - n] -= much
        left[path[0]] -= much
        room[target] -= much
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def moved_cost(old: int, new: int) -> list[list[float]]:
    """A byte that stays in the shard of its number is free, any other costs one."""
    return [[float(i != j) for j in range(new)] for i in range(old)]


class Plan:
    """Flows, and the cuts of each old shard's line of bytes: [(end of the stretch, new shard)]."""

    def __init__(self, sizes: list[int], capacities: list[int], cost: list[list[float]] | None = None):
        self.flow = min_cost_flow(sizes, capacities, cost or moved_cost(len(sizes), len(capacities)))
        self.cuts: list[list[tuple[int, int]]] = []
        for i, row in enumerate(self.flow):
            end, cuts = 0, []
            for j in sorted(range(len(row)), key=lambda j: (j != i, j)):  # what stays comes first: the large rows
                if row[j]:
                    end += row[j]
                    cuts.append((end, j))
            self.cuts.append(cuts)

    def moved(self) -> int:
        return sum(x for i, row in enumerate(self.flow) for j, x in enumerate(row) if i != j)

    def affected(self) -> set[int]:
        """New shards whose files change: all but those that keep just what they had."""
        out = set()
        for k in range(max(len(self.flow), len(self.flow[0]) if self.flow else 0)):
            gives = k < len(self.flow) and any(x for j, x in enumerate(self.flow[k]) if j != k)
            takes = any(row[k] for i, row in enumerate(self.flow) if i != k and k < len(row))
            if gives or takes:
                out.add(k)
        return out


def reshard(docs: DataFrame, old_shard: F.Column, old_shards: int, new_shards: int, to: str, rows_a_block: int = 2_000_000, only_affected: bool = False) -> tuple[DataFrame, Plan]:
    """Writes ``docs`` (all columns, with size, shard and slot) to ``to/shard=<n>/`` and returns the files as a table, and the plan.

    A row weighs the UTF-8 bytes of its text (null: none) and 8. Three passes over ``docs``:
    sizes of the blocks (a sum for each, combined before the shuffle; the driver gets their
    totals, ``old_shards`` x size classes x buckets numbers), rows of the few blocks that are
    cut, and one exchange that carries the texts. No window sees more than one block, which
    holds about ``rows_a_block`` rows of one size class whatever source or copy they come
    from. ``only_affected`` leaves shards that keep just what they have where they are.
    Null and repeated ids are rows like others, dealt to blocks by their texts too; identical rows are told apart by their slots only; clashing
    columns ``size``, ``shard`` and ``slot`` of ``docs`` are replaced; an empty table writes nothing.
    """
    spark = docs.sparkSession
    d = docs.select(*[c for c in docs.columns if c not in ("size", "shard", "slot")], (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 8).alias("size"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("_old"))
    rows = d.count()
    buckets = max(8, -(-rows // (old_shards * rows_a_block)))
    key = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"), F.lit("block"))  # the text deals out rows that share an id or have none
    # size classes from large to small, then buckets of a hash
    block = (F.lit(64) - F.floor(F.log2(F.col("size").cast("double")))).cast("long") * buckets + F.pmod(key, F.lit(buckets))
    d = d.withColumn("_block", block)
    sums = d.groupBy("_old", "_block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("_old", "_block").collect()
    totals = [0] * old_shards
    for r in sums:
        totals[r["_old"]] += r["bytes"]
    plan = Plan(totals, even_capacities(sum(totals), new_shards))

    lines, at, cut_blocks = [], 0, set()
    where: dict[int, int] = dict.fromkeys(range(old_shards), 0)
    for r in sums:
        i, first = r["_old"], where[r["_old"]]
        where[i] = last = first + r["bytes"]
        inside = [(end - first, j) for end, j in plan.cuts[i] if end > first]
        cuts = []
        for end, j in inside:  # (end within the block, shard); the last one holds the rest
            cuts.append((min(end, last - first), j))
            if end >= last - first:
                break
        lines.append((i, r["_block"], r["n"], cuts))
        if len(cuts) > 1:
            cut_blocks.add((i, r["_block"]))
        at += 1

    order = W.partitionBy("_old", "_block").orderBy(F.col("doc_id").asc_nulls_first(), "size", F.xxhash64("text"))

    def shard_of(cuts: F.Column) -> F.Column:
        """The stretch that holds the row's first byte."""
        return F.filter(cuts, lambda c: c["end"] > F.col("_before"))[0]["shard"]

    kind = "_old int, _block long, _cuts array<struct<end: long, shard: int>>"
    before = (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("_before")
    counts: dict[tuple[int, int], dict[int, int]] = {}
    if cut_blocks:
        few = spark.createDataFrame([(i, b, cuts) for i, b, _, cuts in lines if (i, b) in cut_blocks], kind)
        narrow = d.select("_old", "_block", "doc_id", "size", "text").join(F.broadcast(few), ["_old", "_block"]).select("_old", "_block", "_cuts", "size", before)
        for r in narrow.groupBy("_old", "_block", shard_of(F.col("_cuts")).alias("j")).count().collect():
            counts.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    slots, table = [0] * new_shards, []
    for i, b, n, cuts in lines:
        passed, out = 0, []
        for end, j in cuts:
            mine = counts.get((i, b), {}).get(j, 0) if (i, b) in cut_blocks else n
            out.append((end, j, slots[j] - passed))  # slot = this + number of the row in its block
            slots[j] += mine
            passed += mine
        table.append((i, b, out))
    places = spark.createDataFrame(table, "_old int, _block long, _cuts array<struct<end: long, shard: int, base: long>>")
    n = partitions(spark, d)
    dealt = d.repartition(n, "_old", "_block").select("*", before, (F.row_number().over(order) - 1).cast("long").alias("_row"))
    # one line a block: a bounded number, as blocks have about ``rows_a_block`` rows
    placed = dealt.join(F.broadcast(places), ["_old", "_block"]).withColumn("_at", F.filter("_cuts", lambda c: c["end"] > F.col("_before"))[0])
    out = placed.withColumn("shard", F.col("_at.shard")).withColumn("slot", F.col("_at.base") + F.col("_row")).drop("_old", "_block", "_before", "_row", "_cuts", "_at")
    if only_affected:
        out = out.where(F.col("shard").isin(*sorted(plan.affected())))
    out.write.partitionBy("shard").parquet(to)
    fields = [f for f in out.schema.fields if f.name != "shard"]
    schema = type(out.schema)([*fields, *[f for f in out.schema.fields if f.name == "shard"]])
    return spark.read.schema(schema).parquet(to), plan


def shard_documents(docs: DataFrame, old_shards: int = 20, new_shards: int = 24) -> DataFrame:
    """From ``old_shards`` shards by hash of doc_id to ``new_shards`` of nearly equal bytes; what the files then hold.

    Equal texts aren't kept together: a group of copies may be larger than a shard.
    """
    old = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), F.lit(old_shards)).cast("int")
    files, _ = reshard(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), old, old_shards, new_shards, fresh(docs.sparkSession, "shards"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return files.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
