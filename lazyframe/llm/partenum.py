"""Jaccard joins of shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets of nearly equal size and Jaccard similarity t differ in at most
K = (a + b)(1 - t)/(1 + t) features. The feature domain is cut into parts by hash; a
difference touches one part, so similar sets agree in all but K parts, and the subsets
of a set that the parts cut out serve as signatures. A set signs its first K + 1 + slack
nonempty parts, in one order of the parts that all sets of a size band share: the parts
before the first agreeing ones are all touched, so both sets sign these. Two sets share
a signature in at least ``least`` of their parts, not just in one, and that makes common
passages harmless: a signature that very many sets share is set aside unless a set has
so many such ones that its partners might share nothing else.

In the terms of the paper there are K + 1 + slack first-level parts with a second level
of one part, whose only subset is itself. A second level of three parts and its subsets
of two would ask for as many signatures without slack, and the slack is what lets
crowded signatures go.

Sets are told apart by 128 bits of fingerprint: 64 name the node of equal sets, and the
other 64 show where a name stands for different sets; those then get names of their own.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, components, free, mixed, partitions, pieces, removed, sieved, texts, work, written

WORDS = 5
CHECK = 0x3C6EF372FE94F82B
OVER, UNDER = 3, 4  # the similarity 3/4 as a fraction
CROWD = 12
#: A set of n features signs n // SLACK parts more than it must; shared passages hide behind fewer.
SLACK = 6
_FACTORS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_ODD = [np.uint64(int(x)) for x in _FACTORS]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got


_WORDS = _Hashes()


def _forget() -> None:
    _WORDS.clear()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of fewer words, of the whole sequence; else none.

    Only A-Z are lower-cased, and only the six ASCII blanks part words.
    """
    words = (text or "").encode().lower().split()  # on bytes both are ASCII's
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return mixed((h * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = h[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        s += h[k : n - WORDS + 1 + k] * _ODD[k]
    s = mixed(s)
    s.sort()
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def fingerprint(s: np.ndarray, seed: int = 0) -> int:
    return int(mixed(mixed(s ^ np.uint64(seed)).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s)))[0].view(np.int64)) if len(s) else 0


def names(s: np.ndarray, doubtful: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(node, check) of a set: 64 bits each. The node of a ``doubtful`` name, which stands for several sets, follows from both."""
    node, check = fingerprint(s), fingerprint(s, CHECK)
    if node in doubtful:
        node = int(mixed(np.array([node, check], np.int64).view(np.uint64) + np.array([1, 2], np.uint64)).sum(dtype=np.uint64).view(np.int64))
    return node, check


def most_differences(n: int) -> int:
    """Of a set of n features and any set similar to it."""
    return (n + UNDER * n // OVER) * (UNDER - OVER) // (UNDER + OVER)


def band(n: int) -> int:
    """Sizes from 2**b up to 2**(b+1) are one band."""
    return n.bit_length() - 1


def parts_of(b: int) -> int:
    """Parts of the domain for a band: at its largest sets they hold 2.2 features on the average."""
    return max(64, int((2 << b) / 2.2))


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """(signatures, ``least``: how many of them a similar set shares at the least, 1 or more).

    A pair is found in the band of its larger set, so a set near its band's end also signs in the next.
    """
    n = len(s)
    bands = [band(n)]
    if UNDER * n // OVER >= 2 << bands[0]:
        bands.append(bands[0] + 1)
    # a similar set of the least size signs so many beyond its own differences
    out, least = [], 1 + (OVER * n + UNDER - 1) // UNDER // SLACK
    k = most_differences(n)
    wanted = k + 1 + n // SLACK
    scrambled = mixed(s ^ np.uint64(0x5DEECE66D))
    for b in bands:
        m = parts_of(b)
        # parts are ranges of the hash, so those of the sorted set are stretches of it
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        at = part[start]
        name = np.uint64(b << 40)
        least = min(least, max(1, min(wanted, len(at)) - k))
        out.append(mixed(np.add.reduceat(scrambled, start)[:wanted] + mixed(at[:wanted] + name)))
        if len(at) <= k:  # similar sets may agree in nothing but parts that are empty in both
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
            out.append(mixed(mixed(empty + name) + np.uint64(1)))
            least = 1
    return np.concatenate(out).view(np.int64), least


_ROW = "sig long, node long, size int, least int, check long"
_KIND = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("least", pa.int32()), ("check", pa.int64())])
DOCUMENT = -1  # in ``least``: the row stands for a document, with its id as ``sig``
#: Sets that a task remembers to have signed; beyond it copies sign again, which changes no result.
REMEMBERED = 200_000


def _signer(doubtful: frozenset[int]):
    @work("partenum", _forget)
    def sign(batches):
        """Of each document a row with its id, names and size, and of each set its signatures.

        A set that the task has seen before doesn't sign again, so copies stay few.
        """
        seen: set[int] = set()
        for x in pieces(batches, 1000):
            nodes, checks, sizes, sigs, signed, counts, leasts = [], [], [], [], [], [], []
            for text in texts(x.column(1)):
                s = shingles(text)
                f, check = names(s, doubtful)
                nodes.append(f)
                checks.append(check)
                sizes.append(len(s))
                if not len(s) or f in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(f)
                got, least = signatures(s)
                sigs.append(got)
                signed.append((f, len(s)))
                counts.append(len(got))
                leasts.append(least)
            yield batch(_KIND, x.column(0), nodes, sizes, [DOCUMENT] * len(nodes), checks)
            if sigs:
                n = np.array(counts)
                who = np.array(signed, np.int64)
                yield batch(_KIND, np.concatenate(sigs), np.repeat(who[:, 0], n), np.repeat(who[:, 1].astype(np.int32), n), np.repeat(np.array(leasts, np.int32), n), pa.nulls(int(n.sum()), pa.int64()))

    return sign


PAIR, CROWDED, OWN = 0, 1, 2
_FOUND = "kind int, a long, b long, n int, least int, center long, center_size int"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("least", pa.int32()), ("center", pa.int64()), ("center_size", pa.int32())])


class _Meeting:
    """Takes rows sorted by signature and node. Of a signature that up to CROWD sets share it gives all pairs
    of fitting sizes, with how often they met; of any other a row a set, with the first set as its center."""

    def __init__(self):
        self.rest = np.zeros((0, 4), np.int64)  # rows of a signature that may go on
        self.going: tuple[int, int, int] | None = None  # (signature, center, its size) of a crowd that may go on
        self.pairs, self.held = [], 0

    @staticmethod
    def _out(kind, a, b, n, least, center, size):
        k = len(a)
        return batch(_FOUND_SCHEMA, np.full(k, kind, np.int32), a, b, n.astype(np.int32), least.astype(np.int32), np.broadcast_to(np.asarray(center, np.int64), k), np.broadcast_to(np.asarray(size, np.int32), k))

    def _crowd(self, rows, center, size):
        return self._out(CROWDED, rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], center, size)

    def fold(self, all_: bool):
        """Adds up the pairs so far; gives them out if they're many, or all."""
        p = np.concatenate(self.pairs) if self.pairs else np.zeros((0, 4), np.int64)
        if len(p):
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            at = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(1)]))
            n = np.add.reduceat(p[:, 2], at)
            p = p[at]
            p[:, 2] = n
        self.pairs, self.held = [p], len(p)
        if all_ or len(p) > 200_000:
            self.pairs, self.held = [], 0
            yield self._out(PAIR, p[:, 0], p[:, 1], p[:, 2], p[:, 3], 0, 0)

    def take(self, rows: np.ndarray, final: bool):
        rows = np.concatenate([self.rest, rows])
        if self.going is not None and len(rows):
            more = rows[:, 0] == self.going[0]
            if more.any():
                yield self._crowd(rows[more], *self.going[1:])
                rows = rows[~more]
            if len(rows):
                self.going = None
        if len(rows):  # a set that signed in several tasks is there once
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([starts, [len(rows)]]))
        whole = len(starts) if final else max(len(starts) - 1, 0)
        big = np.flatnonzero(lengths[:whole] > CROWD)
        if len(big):
            at = np.repeat(starts[big], lengths[big])
            which = at + np.arange(len(at)) - np.repeat(np.cumsum(lengths[big]) - lengths[big], lengths[big])
            yield self._crowd(rows[which], rows[at, 1], rows[at, 2])
        for k in range(2, CROWD + 1):
            these = starts[:whole][lengths[:whole] == k]
            if len(these):
                at = these[:, None] + np.arange(k)
                i, j = np.triu_indices(k, 1)
                l, r = rows[at[:, i].ravel()], rows[at[:, j].ravel()]
                fits = OVER * np.maximum(l[:, 2], r[:, 2]) <= UNDER * np.minimum(l[:, 2], r[:, 2])
                l, r = l[fits], r[fits]
                self.pairs.append(np.stack([l[:, 1], r[:, 1], np.ones(len(l), np.int64), np.maximum(l[:, 3], r[:, 3])], 1))
                self.held += len(l)
        self.rest = rows[starts[whole] :] if whole < len(starts) else rows[:0]
        if len(self.rest) > 4 * CROWD:
            self.going = tuple(self.rest[0, :3].tolist())
            yield self._crowd(self.rest, *self.going[1:])
            self.rest = self.rest[:0]
        if self.held > 400_000:
            yield from self.fold(False)


@work("partenum", _forget)
def _meet(batches):
    meeting = _Meeting()
    for x in batches:
        own = pc.equal(x.column(3), DOCUMENT)
        mine, x = x.filter(own), x.filter(pc.invert(own))
        if mine.num_rows:
            k, none = mine.num_rows, np.zeros(mine.num_rows, np.int64)
            yield batch(_FOUND_SCHEMA, np.full(k, OWN, np.int32), mine.column(0), mine.column(1), mine.column(2), mine.column(3), mine.column(4), none.astype(np.int32))
        if x.num_rows:
            yield from meeting.take(np.stack([x.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1), False)
    yield from meeting.take(np.zeros((0, 4), np.int64), True)
    yield from meeting.fold(True)


_SET = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("features", pa.binary())])


def sketch(s: np.ndarray) -> bytes:
    """How many features each of 2**k ranges of the hash has, four bits a count; empty where one has over 15."""
    k = max(1, len(s).bit_length() - 1)
    counts = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes() if counts.max() <= 15 else b""


def may_be_similar(a: bytes, b: bytes, m: int, n: int) -> bool:
    """False only if two sets of m and n features with these sketches can't be similar: ranges share no more than the smaller count."""
    if not a or not b:
        return True
    one, two = ((np.stack([x & 15, x >> 4], 1)).ravel().astype(np.int32) for x in (np.frombuffer(y, np.uint8) for y in (a, b)))
    while len(one) != len(two):
        if len(one) > len(two):
            one = one.reshape(-1, 2).sum(1)
        else:
            two = two.reshape(-1, 2).sum(1)
    return (OVER + UNDER) * int(np.minimum(one, two).sum()) >= OVER * (m + n)


def _maker(doubtful: frozenset[int]):
    @work("partenum", _forget)
    def sets(batches):
        seen: set[int] = set()
        for x in pieces(batches, 1000):
            rows = []
            for text in texts(x.column(0)):
                s = shingles(text)
                if len(s) and (f := names(s, doubtful)[0]) not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(f)
                    rows.append((f, len(s), sketch(s), s.tobytes()))
            if rows:
                yield batch(_SET, *zip(*rows, strict=True))

    return sets


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return UNDER * both >= OVER * (len(s) + len(t) - both)


@work("partenum", _forget)
def _likely(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for x in pieces(batches, 5000):
        rows = zip(*(x.column(k).to_pylist() for k in range(2, 6)), strict=True)
        good = np.array([may_be_similar(s, t, m, n) for s, t, m, n in rows], bool)
        yield batch(schema, x.column(0).to_numpy(zero_copy_only=False)[good], x.column(1).to_numpy(zero_copy_only=False)[good])


@work("partenum", _forget)
def _verify(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for x in pieces(batches, 500):
        a, b = x.column(2).to_pylist(), x.column(3).to_pylist()
        good = np.array([similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(a, b, strict=True)], bool)
        yield batch(schema, x.column(0).to_numpy(zero_copy_only=False)[good], x.column(1).to_numpy(zero_copy_only=False)[good])


#: Rows of longs. As a hash table a million takes 67 MB in the driver and each executor, so this many take some 8 MB.
MOST_BROADCAST = 100_000


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, doubtful: frozenset[int]) -> DataFrame:
    """(node, size, sketch, features) of the wanted nodes, from one document of each; no other text is read into a set.

    The ids of those documents are broadcast where a count shows at most ``MOST_BROADCAST``,
    else joined by a shuffle of the documents that a sieve of the ids leaves.
    """
    first = nodes.groupBy("node").agg(F.min("doc_id").alias("id"))  # before the join, so very many copies are one row
    chosen = written(first.join(wanted, "node"), "chosen")
    ids = chosen.where("id is not null").select("id").distinct()
    if ids.count() <= MOST_BROADCAST:
        some = docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"], "left_semi")
    else:
        may = sieved(docs, "doc_id", ids)
        some = may.where(may.columns[-1]).select(*docs.columns)
        some = some.join(ids.hint("merge"), some["doc_id"] == ids["id"], "left_semi")
    if not chosen.where("id is null").isEmpty():  # sets that only rows without an id have
        some = some.union(docs.where("doc_id is null"))
    sets = some.select("text").mapInArrow(_maker(doubtful), "node long, size int, sketch binary, features binary").join(chosen.select("node"), "node", "left_semi")
    out = written(sets.dropDuplicates(["node"]), "sets")
    removed(chosen)
    return out


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sketches travel first, and features only for the pairs that these leave."""
    one = sets.select(F.col("node").alias("a"), F.col("sketch").alias("s"), F.col("size").alias("m"))
    two = sets.select(F.col("node").alias("b"), F.col("sketch").alias("t"), F.col("size").alias("n"))
    pairs = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "s", "t", "m", "n").mapInArrow(_likely, "a long, b long")
    one = sets.select(F.col("node").alias("a"), F.col("features").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("features").alias("t"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_verify, "u long, v long")


@work("partenum", _forget)
def _features(batches):
    schema = pa.schema([("f", pa.int64()), ("node", pa.int64())])
    for x in pieces(batches, 1000):
        sets = [np.frombuffer(s, np.int64) for s in x.column(1).to_pylist()]
        if sets:
            yield batch(schema, np.concatenate(sets), np.repeat(x.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets]))


_PARTED = "f long, node long, size int, root long, common array<long>, rest int"
_PARTED_SCHEMA = pa.schema([("f", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("root", pa.int64()), ("common", pa.list_(pa.int64())), ("rest", pa.int32())])


@work("partenum", _forget)
def _parted(batches):
    """Of (node, size, root, features, common): a row for each uncommon feature that a similar set may share first,
    and of a set that common features alone can make similar a row with these and their fingerprint."""
    for x in pieces(batches, 200):
        rows = []
        for node, size, root, features, common in zip(*(c.to_pylist() for c in x.columns), strict=True):
            features, common = np.frombuffer(features, np.int64), np.array(common or [], np.int64)
            rare = np.setdiff1d(features, common, assume_unique=True)
            rows += [(f, node, size, root, None, None) for f in np.sort(rare)[: size * (UNDER - OVER) // UNDER + 1].tolist()]
            if UNDER * len(common) >= OVER * size:
                rows.append((fingerprint(np.sort(common.view(np.uint64))), node, size, root, common, size - len(common)))
        if rows:
            yield batch(_PARTED_SCHEMA, *zip(*rows, strict=True))


def _numbered(common: DataFrame) -> DataFrame:
    """(f, number): features by numbers from 0 on, which are half as wide while there are less than 2**31."""
    at = F.monotonically_increasing_id()
    ids = written(common.select("f", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("k")), "numbered")
    start, starts = 0, []
    for part, n in ids.groupBy("part").count().orderBy("part").collect():  # one number a partition
        starts.append((part, start))
        start += n
    starts = F.broadcast(common.sparkSession.createDataFrame(starts, "part int, start long"))
    return ids.join(starts, "part").select("f", (F.col("start") + F.col("k")).cast("int" if start < 1 << 31 else "long").alias("number"))


def _meeting_apart(rows: DataFrame, side: str, names: tuple[str, ...], fits: str = "true", **bounds) -> DataFrame:
    """Pairs of ``rows`` with equal ``f`` and different ``side``; rows of one side never meet, however many they are.

    ``fits`` tests the ``bounds`` (column: aggregate over a side) of pairs of sides, of a row
    and a side and of two rows; if it fails for a side's aggregates it must fail for its rows.
    """
    sides = rows.groupBy("f", side).agg(*[how(x).alias(x) for x, how in bounds.items()]) if bounds else rows.select("f", side).distinct()
    one, two = (sides.select("f", *[F.col(x).alias(f"{x}_{k}") for x in (side, *bounds)]) for k in "ab")
    met = one.join(two, "f").where(f"{side}_a < {side}_b").where(fits)
    for k in "ab":
        met = met.drop(*[f"{x}_{k}" for x in bounds]).join(rows.select("f", *[F.col(x).alias(f"{x}_{k}") for x in (side, *names, *bounds)]).hint("merge"), ["f", f"{side}_{k}"]).where(fits)
    return met


def _apart_pairs(sets: DataFrame, at: DataFrame) -> DataFrame:
    """Candidates (a, b) among the sets ``at`` (node, size, root) of crowds; with the links so far they connect all that similar pairs connect.

    A feature is common if more than ``CROWD`` of these sets hold it. Of a similar pair that
    shares uncommon features, the first of them is among the first quarter of either's; so few
    hold it that its pairs are listed. The others share common features only. Sets with equal
    common features (a class) are then as similar as their other features are few, so each
    set meets the one of its class that has the fewest, and that of each class
    whose common features are similar to its own. Pairs of classes whose sizes rule
    similarity out are dropped inside the joins, and any other is listed once.
    """
    own = sets.select("node", "features").join(at, "node").select("node", "size", "root", "features")
    common = written(own.select("node", "features").mapInArrow(_features, "f long, node long").groupBy("f").count().where(F.col("count") > CROWD).select("f"), "common")
    few = F.broadcast(common) if common.count() <= MOST_BROADCAST else common
    held = own.select("node", "features").mapInArrow(_features, "f long, node long").join(few, "f").groupBy("node").agg(F.sort_array(F.collect_list("f")).alias("common"))
    numbers = _numbered(common)
    parted = written(own.join(held, "node", "left").mapInArrow(_parted, _PARTED), "parted")
    rare = parted.where("rest is null").select("f", "node", "size", "root")
    rare = _meeting_apart(rare, "root", ("node", "size")).where(_fit("size_a", "size_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    heavy = parted.where("rest is not null").withColumnRenamed("f", "class")
    classes = heavy.groupBy("class").agg(F.min_by(F.struct("node", "root"), F.struct("rest", "node")).alias("best"), F.min("rest").alias("rest"), F.first("common").alias("common"), F.min("root").alias("low"), F.max("root").alias("high"))
    # a class within one component has that as its side
    classes = written(classes.select("class", F.col("best.node").alias("best"), F.col("best.root").alias("best_root"), "rest", "common", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("class")).alias("side")), "classes")
    stars = heavy.select("class", "node", "root").join(classes.select("class", "best", "best_root"), "class").where("root <> best_root").select("node", "best")
    each = classes.select("class", F.explode("common").alias("f")).join(F.broadcast(numbers) if common.count() <= MOST_BROADCAST else numbers, "f").select("class", F.col("number").alias("f"))
    first = each.join(each.groupBy("f").count(), "f").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("count", "f"))).alias("o"))
    # a pair's common features alone must reach 3/4 of the whole set, so the more others it has, the fewer of them may be missing
    alone = classes.groupBy("side").agg((F.count(F.lit(1)) == 1).alias("alone"))
    first = first.join(classes.select("class", "side", "rest"), "class").join(alone, "side").select("class", "side", "alone", F.size("o").alias("held"), (F.size("o") + F.col("rest")).alias("least"), F.expr(f"slice(o.f, 1, cast((size(o) * {UNDER - OVER} - rest * {OVER}) div {UNDER} as int) + 1)").alias("first"))
    # a row for each feature in front, with those before it
    first = written(first, "first").select("class", "side", "alone", "held", "least", "first", F.posexplode("first").alias("at", "f")).withColumn("before", F.expr("slice(first, 1, at)")).drop("first", "at")
    # two classes share no more than the smaller one's common features, and meet at the first that both have in front
    fits, here = f"{OVER + UNDER} * least(held_a, held_b) >= {OVER} * (least_a + least_b)", "not arrays_overlap(before_a, before_b)"
    one, two = (first.select("f", *[F.col(x).alias(f"{x}_{k}") for x in ("class", "side", "alone", "held", "least", "before")]) for k in "ab")
    # fronts are lists that grow as they are unfolded, far beyond what their table's size tells, so they are never broadcast
    near = one.join(two.where("alone_b").hint("merge"), "f").where("side_a <> side_b and (not alone_a or class_a < class_b)").where(fits).where(here).select("class_a", "class_b")
    more = _meeting_apart(first.where("not alone"), "side", ("class", "before"), fits, held=F.max, least=F.min)
    near = near.union(more.where(here).select("class_a", "class_b"))
    for k in "ab":
        near = near.join(classes.select(*[F.col(x).alias(f"{x}_{k}") for x in ("class", "best", "rest", "common")]).hint("merge"), f"class_{k}")
    near = near.withColumn("both", F.size(F.array_intersect("common_a", "common_b")))
    enough = f"{OVER + UNDER} * both >= {OVER} * "
    near = written(near.where(enough + "(size(common_a) + size(common_b) + rest_a + rest_b)").select("class_a", "class_b", "best_a", "best_b", "both", F.expr("size(common_a) + rest_a").alias("size_a"), F.expr("size(common_b) + rest_b").alias("size_b")), "near")
    across = [heavy.select(F.col("class").alias(f"class_{k}"), "node", "size").join(near, f"class_{k}").where(enough + f"(size + size_{o})").select("node", F.col(f"best_{o}").alias("best")) for k, o in ("ab", "ba")]
    rest = stars.union(across[0]).union(across[1]).select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b"))
    return written(rare.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(rest).distinct(), "more")


def _fit(a: str, b: str) -> F.Column:
    return F.greatest(a, b) * OVER <= F.least(a, b) * UNDER


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and fingerprint of every row of ``docs``.

    Null ids belong to a component but don't name it; a component of null ids only has
    none. Null, empty and blank texts have an empty set and link with nothing. Repeated rows
    are equal sets. Extra columns are ignored; an empty table gives none.

    The signatures travel once (sorted, spillable); candidates and the crowded signatures
    are written to the shared folder. A set stays in crowds only if it has so many crowded
    signatures that a similar set may share no other. There each set first meets the
    crowd's center, which settles a group of near copies in one comparison a set; only
    crowds whose sets are still in different components are compared further, see
    ``_apart_pairs``.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(docs.sparkSession, every, 2)
    doubtful: frozenset[int] = frozenset()
    while True:
        signed = every.mapInArrow(_signer(doubtful), _ROW).repartition(n, F.coalesce("sig", "node")).sortWithinPartitions("sig", "node")
        met = written(signed.mapInArrow(_meet, _FOUND), "met")
        nodes = written(met.where(f"kind = {OWN}").select(F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("b").alias("node"), F.col("center").alias("check")), "nodes")
        # names that stand for several sets: of n sets some n * n / 2**65, none in practice
        more = {r[0] for r in nodes.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node").collect()}
        if not more:
            break
        doubtful |= more
        removed(met, nodes)
    nodes = nodes.drop("check")
    # a set has few signatures, so a window over it is small whatever the crowds are
    mine = W.partitionBy("node")
    crowds = met.where(f"kind = {CROWDED}").select(F.col("a").alias("sig"), F.col("b").alias("node"), F.col("n").alias("size"), "least", "center", "center_size").distinct()
    crowds = written(crowds.withColumn("crowded", F.count(F.lit(1)).over(mine)), "crowds")
    c = crowds.groupBy("node").agg(F.max("crowded").alias("crowded"))
    pairs = written(met.where(f"kind = {PAIR}").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")), "pairs")
    cold = pairs.join(c.select(F.col("node").alias("a"), F.col("crowded").alias("ca")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("crowded").alias("cb")), "b", "left")
    # a similar pair shares ``least`` signatures; those that don't count here are crowded for both
    cold = cold.where(F.col("n") + F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))) >= F.col("least")).select("a", "b")
    full = crowds.where("crowded >= least")
    stars = full.where("center <> node").where(_fit("size", "center_size")).select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
    pairs_now = written(cold.union(stars).distinct(), "candidates")
    wanted = pairs_now.select(F.explode(F.array("a", "b")).alias("node")).union(full.select("node")).distinct()
    sets = _sets_of(every, nodes, wanted, doubtful)
    links = written(_verified(sets, pairs_now), "links")
    removed(met, pairs, pairs_now)
    if not full.isEmpty():
        roots = components(links)
        # crowds that aren't one component: some set isn't in its center's
        ray = full.select("center", "node").distinct().join(roots, "node", "left").select("center", "node", F.coalesce("root", "node").alias("x"))
        ray = ray.join(roots.select(F.col("node").alias("center"), "root"), "center", "left").where(F.col("x") != F.coalesce("root", "center")).select("center", "node")
        apart = written(full.join(ray, ["center", "node"], "left_semi").select("sig").distinct(), "apart")
        if not apart.isEmpty():
            at = full.join(apart, "sig", "left_semi").select("node", "size").distinct().join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
            links = written(links.union(_verified(sets, _apart_pairs(sets, written(at, "apart-sets")))), "links")
    removed(crowds, sets)
    roots = components(links)
    # equal sets are summed up before they meet the components, so a text that very many rows hold is one row
    each = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("id")).join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    each = written(each, "each")
    least = each.groupBy("root").agg(F.min("id").alias("component_id"))
    least = written(each.join(least, "root").select("node", "component_id"), "named")
    # empty sets are components of their own
    return nodes.join(least, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("node").alias("fingerprint"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are first of their component; see ``groups``.

    An id goes if none of its rows is first; rows without id stay, as nothing names them;
    of rows with the same id and text one stays. The ids that go are broadcast where a count
    shows that they are few, else joined by a shuffle of the rows that a sieve of the ids leaves.
    """
    g = written(groups(docs), "groups")
    name = free(docs, "gone")[0]
    gone = g.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first")).where("first = 0").select(name)
    gone = written(gone, "gone")
    if gone.count() <= MOST_BROADCAST:
        kept = docs.join(F.broadcast(gone), docs["doc_id"].cast("long") == gone[name], "left_anti")
    else:
        may = sieved(docs, "doc_id", gone)
        some = may.where(may.columns[-1]).select(*docs.columns)
        kept = may.where(~F.col(may.columns[-1])).select(*docs.columns).union(some.join(gone.hint("merge"), some["doc_id"].cast("long") == gone[name], "left_anti"))
    again = g.where("doc_id is not null").groupBy("doc_id", "fingerprint").count().where("count > 1")
    if again.isEmpty():
        return kept
    row = free(kept, "row")[0]
    order = W.partitionBy("doc_id", F.xxhash64("text"), F.crc32(F.col("text").cast("string").cast("binary"))).orderBy("doc_id")
    return kept.withColumn(row, F.row_number().over(order)).where(f"{row} = 1 or doc_id is null").drop(row)
