"""Mixing by soft membership: rates a document that bring the expected tokens of each domain to a target.

A naive Bayes classifier over hashed words, taught by a labelled table, gives each
document a posterior p over the domains. With n tokens and rate r its expected tokens go
to the domains as n r p. Nonnegative rates bring the domains' shares of tokens to the
targets by accelerated projected gradient, which starts at rate 1 and leaves it no further
than the targets ask. The squared distance is measured by the inverse of the domains'
second moments, so a rare domain counts as much as a large one and a step has length 1.
A step needs one sum a domain over all documents, and since a document's rate follows
from p and the sums so far, no rates are stored or shuffled.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, free, pieces, texts, with_texts, work, written

BUCKETS = 1 << 15


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return got


def _words(text: str) -> list[str]:
    return text.lower().split()


class Classifier:
    """``evidence`` bounds how many words' worth of evidence a text gives, which keeps long texts soft."""

    def __init__(self, domains: list[str], log_prior: np.ndarray, table: np.ndarray, evidence: float):
        self.domains, self.log_prior, self.table, self.evidence = domains, log_prior, table, evidence

    def posteriors(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(a row of posteriors a text, words a text)."""
        out, n = np.zeros((len(many), len(self.domains))), np.zeros(len(many), np.int64)
        for k, text in enumerate(many):
            words = _words(text)
            n[k] = len(words)
            z = self.log_prior
            if words:
                at = _places(words)
                total = np.bincount(at, minlength=BUCKETS) @ self.table if len(words) > 4096 else self.table[at].sum(0)
                z = z + total * (min(len(words), self.evidence) / len(words))
            e = np.exp(z - z.max())
            out[k] = e / e.sum()
        return out, n


_BUCKETS = _Buckets()


def _forget() -> None:
    _BUCKETS.clear()


def _places(words: list[str]) -> list[int]:
    return list(map(_BUCKETS.__getitem__, words))


def learn_classifier(docs: DataFrame, labelled: DataFrame, most_labelled: int = 20_000, most_domains: int = 64, evidence: float = 12.0) -> Classifier | None:
    """From ``labelled`` (doc_id, domain): at most ``most_labelled`` rows of the least hash teach; null ids and domains don't.
    None if there is no usable row."""
    spark = docs.sparkSession
    rows = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id", F.lit("mix")), "doc_id").limit(most_labelled).collect()
    domains = sorted({r["domain"] for r in rows})
    if not domains:
        return None
    if len(domains) > most_domains:
        raise ValueError(f"there are {len(domains)} domains; up to {most_domains} can be mixed")
    number = {x: k for k, x in enumerate(domains)}
    table = spark.createDataFrame([(r["doc_id"], number[r["domain"]]) for r in rows], "doc_id long, domain int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(table), "doc_id").select("domain", "text")

    @work("mixing", _forget)
    def run(batches):
        counts = np.zeros((len(domains), BUCKETS), np.int64)
        for x in pieces(batches, 1000):
            for k, text in zip(x.column(0).to_pylist(), texts(x.column(1)), strict=True):
                words = _words(text)
                if words:
                    counts[k] += np.bincount(_places(words), minlength=BUCKETS)
        k, at = counts.nonzero()
        yield batch(pa.schema([("domain", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())]), k.astype(np.int32), at.astype(np.int32), counts[k, at])

    counts = np.zeros((len(domains), BUCKETS))
    for r in sample.mapInArrow(run, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n")).collect():  # at most domains x BUCKETS
        counts[r[0], r[1]] = r[2]
    sizes = np.bincount([number[r["domain"]] for r in rows], minlength=len(domains))
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return Classifier(domains, np.log(sizes / sizes.sum()), np.ascontiguousarray(logs.T.astype(np.float32)), evidence)


def temperature_targets(shares: np.ndarray, power: float = 0.5) -> np.ndarray:
    """Target tokens, as multiples of all tokens: weights share**power, scaled so that no domain shrinks."""
    w = np.where(shares > 0, shares, 0) ** power
    w = w / w.sum() if w.sum() else w
    return w * max((s / x for s, x in zip(shares, w, strict=True) if x > 0), default=0.0)


#: Added to the second moments, as a share of a domain's tokens: domains that no posteriors tell apart take many small steps.
RIDGE = 1e-3


def rates(p: np.ndarray, history: list[tuple[np.ndarray, float]], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(rates of ``least`` and more, the point of the next gradient) of rows with posteriors ``p`` after the steps so far."""
    r = y = np.ones(len(p))
    for move, momentum in history:
        new = np.maximum(least, y - p @ move)
        r, y = new, new + momentum * (new - r)
    return r, y


class Mix:
    """A fitted mix: turns posteriors into rates, and rates into whole copies by a hash of the row."""

    def __init__(self, classifier: Classifier, targets: np.ndarray, history: list, reached: np.ndarray, least: float = 0.0):
        self.classifier, self.targets, self.history, self.reached, self.least = classifier, targets, history, reached, least

    def of(self, many: list[str]) -> np.ndarray:
        return rates(self.classifier.posteriors(many)[0], self.history, self.least)[0]


def gaps(reached: np.ndarray, targets: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The distance of each domain's tokens to its target as a part of the target, or of its present tokens where none are wanted."""
    of = np.where(targets > 0, targets, shares)
    return np.abs(reached - targets) / np.where(of > 0, of, 1.0)


def fit_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, most_rounds: int = 60, tolerance: float = 1e-4, keep_all: bool = False) -> tuple[Mix, DataFrame] | None:
    """The mix, and (doc_id, chance, n, p) of every row, kept in the shared folder.

    ``weights``: domain -> share wanted (summing to 1); without it ``temperature_targets`` of the present shares.
    Steps go on until each domain is within ``tolerance`` of its own target. Some targets can't be met, as one
    beyond what any document's posterior gives; a warning then names the domains with target and tokens reached.
    ``keep_all``: no rate is below 1 where no target is below a domain's present tokens. Soft posteriors then
    bring the domains that don't grow a little beyond their targets. None without a usable row in ``labelled``."""
    classifier = learn_classifier(docs, labelled)
    if classifier is None:
        return None
    k = len(classifier.domains)

    @work("mixing", _forget)
    def run(batches):
        for x in pieces(batches, 1000):
            p, n = classifier.posteriors(texts(x.column(1)))
            yield batch(pa.schema([("doc_id", pa.int64()), ("chance", pa.float64()), ("n", pa.int64()), ("p", pa.list_(pa.float64()))]), x.column(0), x.column(2), n, list(p))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("chance", _chance())
    table = written(d.mapInArrow(run, "doc_id long, chance double, n long, p array<double>"), "posteriors")

    def sums(history: list) -> tuple[np.ndarray, np.ndarray]:
        """The domains' tokens at the present rates, and at the point of the next gradient."""

        @work("mixing", _forget)
        def run(batches):
            total = np.zeros(2 * k)
            for x in batches:
                n = x.column(0).to_numpy(zero_copy_only=False)
                p = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
                r, y = rates(p, history, least)
                total[:k] += (n * r) @ p
                total[k:] += (n * y) @ p
            yield batch(pa.schema([("x", pa.list_(pa.float64()))]), [total])

        total = summed(run, 2 * k)
        return total[:k] / tokens, total[k:] / tokens

    def summed(run, size: int) -> np.ndarray:
        rows = table.select("n", "p").mapInArrow(run, "x array<double>").collect()  # at most 1 + k * k numbers a task
        return np.sum([r[0] for r in sorted(rows)], axis=0) if rows else np.zeros(size)

    @work("mixing", _forget)
    def moments(batches):
        total = np.zeros(1 + k * k)
        for x in batches:
            n = x.column(0).to_numpy(zero_copy_only=False)
            p = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
            total[0] += n.sum()
            total[1:] += (p.T @ (n[:, None] * p)).ravel()
        yield batch(pa.schema([("x", pa.list_(pa.float64()))]), [total])

    start = summed(moments, 1 + k * k)
    tokens = max(start[0], 1.0)
    second = start[1:].reshape(k, k) / tokens
    shares = second.sum(1)  # a row's posteriors sum to 1
    if weights is None:
        targets = temperature_targets(shares)
    else:
        w = np.array([weights.get(x, 0.0) for x in classifier.domains])
        targets = w * max((s / x for s, x in zip(shares, w, strict=True) if x > 0), default=1.0)
    # in units of the root of its share every domain has a second moment of 1 if its documents are clear
    unit = np.sqrt(np.where(shares > 0, shares, 1.0))
    inverse = np.linalg.pinv(second / np.outer(unit, unit) + RIDGE * np.diag((shares > 0).astype(float)), hermitian=True) / np.outer(unit, unit)
    least = float(keep_all and (targets >= shares * (1 - 1e-9)).all())
    history: list[tuple[np.ndarray, float]] = []
    reached, at, t, still = shares, shares, 1.0, 0
    while gaps(reached, targets, shares).max() > tolerance and len(history) < most_rounds and still < 3:
        new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append((inverse @ (at - targets), (t - 1) / new))
        before, t = reached, new
        reached, at = sums(history)
        still = still + 1 if gaps(reached, before, shares).max() <= tolerance * 1e-3 else 0  # nearer it doesn't get
    gap = gaps(reached, targets, shares)
    if gap.max() > tolerance:
        told = ", ".join(f"{x} {b:.6g} of {a:.6g}" for x, a, b, g in zip(classifier.domains, targets, reached, gap, strict=True) if g > tolerance)
        warnings.warn(f"domains that miss their target (reached of target, in tokens a present token): {told}", stacklevel=2)
    return Mix(classifier, targets, history, reached, least), table


def _chance() -> F.Column:
    """A number in [0, 1) that follows from the row's id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate, copies, target, reached of every row.

    ``copies`` is the rate rounded down, or up with the chance of its fraction; ``target`` and
    ``reached`` are the tokens of the row's domain, as multiples of all present tokens, so a
    target that was missed shows in the result. Null and empty texts have no tokens and the
    prior as posterior; repeated rows have equal rates; null ids are rows like others; an
    empty table gives no row. Where ``labelled`` has no usable row nothing is known: domain,
    target and reached are null, the posterior is empty, and each row stays once.
    """
    fitted = fit_mix(docs, labelled, weights)
    if fitted is None:
        words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", " ")), " ")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(words, lambda w: w != "")).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(None).cast("double").alias("target"), F.lit(None).cast("double").alias("reached"))
    mix, table = fitted

    @work("mixing", _forget)
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("domain", pa.string()), ("posterior", pa.list_(pa.float64())), ("rate", pa.float64()), ("chance", pa.float64()), ("target", pa.float64()), ("reached", pa.float64())])
        for x in batches:
            p = x.column(3).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, len(mix.classifier.domains))
            best = p.argmax(1)
            yield batch(schema, x.column(0), x.column(2), [mix.classifier.domains[k] for k in best], x.column(3), rates(p, mix.history)[0], x.column(1), mix.targets[best], mix.reached[best])

    out = table.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior array<double>, rate double, chance double, target double, reached double")
    copies = (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias("copies")
    return out.select("doc_id", "n_tokens", "domain", "posterior", "rate", copies, "target", "reached")


def mixed_documents(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, keep_all: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say; see ``mix_rates``, and ``fit_mix`` for ``keep_all``."""
    fitted = fit_mix(docs, labelled, weights, keep_all=keep_all)
    if fitted is None:
        return docs
    mix = fitted[0]
    d, at, width = with_texts(docs)
    d = d.withColumn(free(d, "chance")[0], _chance())

    @work("mixing", _forget)
    def copied(batches):
        for x in pieces(batches, 1000):
            r, chance = mix.of(texts(x.column(at))), x.column(x.num_columns - 1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(x.num_rows), (np.floor(r) + (chance < r - np.floor(r))).astype(np.int64))
            own = x.select(list(range(width)))
            for k in range(0, len(rows), 1000):
                yield own.take(pa.array(rows[k : k + 1000]))

    return d.mapInArrow(copied, docs.schema)
