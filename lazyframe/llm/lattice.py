"""Near-duplicates of embeddings by E8 lattice hashing.

In each table random directions take a vector to two blocks of eight numbers, and each
block to a point of the E8 lattice. A vector is entered at its own cell and at the next
nearest ones, so vectors that lie close on two sides of a border still meet. Vectors
that share a cell are compared by cosine in double precision, as one matrix product.
Equal vectors are one class from the start, and only the class's first vector travels.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, components, local_forest, mixed, partitions, pieces, removed, work, written

TABLES = 10
BLOCKS = 2
PROBES = 2  # cells a block
SCALE = 0.5  # of the directions: how far apart two unit vectors come to lie depends on it and not on their length
MOST_IN_TASK = 2048
COSINE = 0.9


def nearest_e8(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8): twice the nearest lattice points found, nearest first.

    E8 is D8 and D8 moved by a half. In each the rounded point, or the one with the worst
    coordinate rounded the other way where the parity is odd, is nearest; rounding further
    coordinates the other way gives the neighbours.
    """
    found, costs = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        d = y - r
        worst = np.argsort(-np.abs(d), axis=1, kind="stable")
        other = np.where(d >= 0, 1.0, -1.0)
        odd = (r.sum(1).astype(np.int64) & 1).astype(bool)
        rows = np.arange(len(x))
        # even: none, or the worst with the second or third; odd: one of the three worst
        for even_flips, odd_flips in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,))):
            p = r.copy()
            for flips, mine in ((even_flips, ~odd), (odd_flips, odd)):
                for k in flips:
                    at = worst[mine, k]
                    p[rows[mine], at] += other[mine, at]
            found.append(2 * (p + shift))
            costs.append(((y - p) ** 2).sum(1))
    points, cost = np.stack(found, 1), np.stack(costs, 1)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(points, best[:, :, None], 1).astype(np.int64)


class Lattice:
    def __init__(self, size: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        # a unit difference is projected to a block's eight numbers with the length scale * sqrt(8) on the average
        self.directions = rng.normal(0, scale, (tables, size, blocks * 8))
        self.factors = rng.integers(1, 1 << 62, (tables, blocks, 8), dtype=np.int64).view(np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes**blocks) cells of unit vectors; numbers of different tables don't mix."""
        out = np.empty((len(x), self.tables, self.probes**self.blocks), np.int64)
        for t in range(self.tables):
            z = x @ self.directions[t]
            sums = None
            for b in range(self.blocks):
                cells = nearest_e8(z[:, b * 8 : b * 8 + 8], self.probes).view(np.uint64)
                h = mixed((cells * self.factors[t, b]).sum(2, dtype=np.uint64) + np.uint64(b + 1))
                sums = h if sums is None else (sums[:, :, None] + h[:, None, :]).reshape(len(x), -1)
            out[:, t] = (mixed(sums) & np.uint64((1 << 57) - 1) | np.uint64(t << 57)).view(np.int64)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of usable vectors as unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(x @ y.T >= least)


@lru_cache(maxsize=4)
def lattice_of(size: int, tables: int) -> Lattice:
    return Lattice(size, tables)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_vectors(vectors: DataFrame, least: float = COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Equal vectors count as links like others, but are one class: of each class one vector is
    entered and compared, with its number of vectors as weight. A pair that meets in several
    cells is counted in the cell of the least number only, so counts add up without a table
    of pairs; for components a cell gives a spanning forest of its links. A cell of more than
    ``MOST_IN_TASK`` classes is cut into blocks by hash, and each pair of blocks is compared
    in a task of its own. Vectors of different lengths never link; each length has a lattice
    of its own. Vectors that are null, zero, or hold null or non-finite components link with
    nothing. Rows with the same vec_id are one vector, the least of them; a null vec_id gives
    a row without links; other columns are left aside. An empty table gives none. A vector's
    length is bounded by memory only: a cell holds two blocks of vectors at a time.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    known = v.where("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # two hashes of 64 bits name a class
    known = written(known.where(finite & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")), "vectors")
    classes = written(known.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    first = known.join(classes.select(F.col("rep").alias("vec_id"), "n"), "vec_id").select("vec_id", "n", "embedding")
    cell_schema = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("vec_id", pa.int64())])

    @work("lattice", lattice_of.cache_clear)
    def enter(batches):
        for x in pieces(batches, 2000):
            lengths = np.array([len(e) for e in x.column(1)])
            for size in np.unique(lengths).tolist():
                part = x.filter(pa.array(lengths == size))
                keys = lattice_of(size, tables).keys(unit(_rows(part.column(1)))).reshape(part.num_rows, -1)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield batch(cell_schema, keys.ravel(), np.full(len(ids), size, np.int32), ids)

    n = partitions(spark, v)
    entered = written(first.select("vec_id", "embedding").mapInArrow(enter, "key long, size int, vec_id long"), "entered")
    # cells without company are dropped before the vectors travel on
    sizes = entered.groupBy("key", "size").count().where("count > 1")
    placed = entered.join(sizes, ["key", "size"]).join(first, "vec_id")
    parts = F.ceil(F.col("count") / F.lit(MOST_IN_TASK / 2)).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    split = placed.withColumn("parts", F.when(F.col("count") > MOST_IN_TASK, parts).otherwise(1)).withColumn("mine", mine)
    # block m goes to the pairs (m, k) and (k, m); a cell within the bound has the single pair (0, 0)
    split = split.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "size", F.least("mine", "k").alias("a"), F.greatest("mine", "k").alias("b"), "mine", "vec_id", "n", "embedding")

    @work("lattice", lattice_of.cache_clear)
    def compare(batches):
        held: list = []
        results: list = []
        schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

        def done() -> None:
            """The links of the cell in ``held``: weights a vector, and a spanning forest."""
            key, size, a, b = held[0][0]
            block, ids, weight = (np.concatenate([h[1].column(c).to_numpy(zero_copy_only=False) for h in held]) for c in (4, 5, 6))
            x = unit(np.concatenate([_rows(h[1].column(7)) for h in held]))
            lattice, keys = lattice_of(size, tables), None
            width = lattice.probes**lattice.blocks
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            counts, us, vs = np.zeros(len(ids), np.int64), [], []
            for s in range(0, len(left), 512):
                i, j = _linked(x[left[s : s + 512]], x[right], least)
                i, j = left[s + i], right[j]
                use = i < j if a == b else np.ones(len(i), bool)
                i, j = i[use], j[use]
                if len(i) and keys is None:  # most cells hold no link and need none of this
                    keys = lattice.keys(x).reshape(len(x), -1)
                for q in range(0, len(i), 20_000):
                    p, r = i[q : q + 20_000], j[q : q + 20_000]
                    earlier = np.zeros(len(p), bool)
                    for t in range(0, keys.shape[1], width):
                        kp, kr = keys[p, t : t + width], keys[r, t : t + width]
                        earlier |= ((kp[:, :, None] == kr[:, None, :]) & (kp[:, :, None] < key)).any((1, 2))
                    np.add.at(counts, p[~earlier], weight[r[~earlier]])
                    np.add.at(counts, r[~earlier], weight[p[~earlier]])
                us.append(ids[i])
                vs.append(ids[j])
            if us:
                node, root = local_forest(np.concatenate(us), np.concatenate(vs))
                roots = dict(zip(node.tolist(), root.tolist(), strict=True))
                root = np.array([roots.get(k, k) for k in ids.tolist()], np.int64)
                some = (counts > 0) | (root != ids)
                if some.any():
                    results.append((ids[some], counts[some], root[some]))

        for x in batches:
            cell = np.stack([x.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])) if len(cell) else []
            for s, e in zip(starts, [*starts[1:], len(cell)], strict=True):
                name = tuple(cell[s].tolist())
                if held and held[0][0] != name:
                    done()
                    held.clear()
                held.append((name, x.slice(s, e - s)))
            if results:
                yield batch(schema, *(np.concatenate(c) for c in zip(*results, strict=True)))
                results.clear()
        if held:
            done()
        if results:
            yield batch(schema, *(np.concatenate(c) for c in zip(*results, strict=True)))

    dealt = split.repartition(n, "key", "size", "a", "b").sortWithinPartitions("key", "size", "a", "b")
    found = written(dealt.mapInArrow(compare, "vec_id long, n long, root long"), "links")
    removed(entered)
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    of_class = classes.join(counts, "rep", "left").join(roots, "rep", "left")
    of_class = written(of_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "of-class")
    # a class that very many vectors share is one row here, and a skewed join's left side can be split
    out = v.select("vec_id").join(known.select("vec_id", "h1", "h2"), "vec_id", "left").join(of_class, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
