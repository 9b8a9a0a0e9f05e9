"""Quality by positive-unlabelled learning: the non-negative risk of Kiryo et al. (2017).

Trusted texts (label 1) and unlabelled texts train a small network on measures of form.
With class prior p the risk is p R(P, +) + max(0, R(U, -) - p R(P, -)); where the second
part falls below zero the step climbs back instead. The prior comes from the trusted
texts and counts over all others: of all score thresholds the one with the least upper
bound for the share of unlabelled texts above it by the share of trusted ones (Garg et
al., 2021).

Texts are measured once and the measures kept. Every unlabelled row teaches: in a round
each task goes on from the common weights with steps on its own rows, beside the trusted
texts, and the mean of the tasks' weights, by their rows, is common to the next round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, crc_of_id, pieces, texts, work, written
from .toxicity import labelled

_CLASSES = np.zeros((256, 8), np.float32)
for _b in range(256):
    _c = chr(_b)
    _k = 0 if _c in " \t\n\r" else 1 if _c in "abcdefghijklmnopqrstuvwxyz" else 2 if _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3 if _c in "0123456789" else 4 if _c in ".,;:'\"-()" else 5 if _c in "!?" else 6 if _b < 128 else 7
    _CLASSES[_b, _k] = 1
N_FEATURES = 20


def form(text: str) -> list[float]:
    """Measures of a whole text's form; all finite, also for the empty text."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(len(data), 1)
    counts = np.bincount(data, minlength=256)
    shares = (counts @ _CLASSES) / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(len(words), 1)
    kinds = len(set(words))
    lines = text.split("\n")
    letters = sum(map(len, words)) / m
    same = sum(map(str.__eq__, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / max(m - 1, 1)
    ended = sum(1 for w in words if not w[-1].isalnum()) / m
    upper = sum(map(str.isupper, words)) / m
    title = sum(map(str.istitle, words)) / m
    return [*shares[1:], float(-(p * np.log2(p)).sum()) / 8, np.log1p(n) / 10, kinds / m, np.log1p(kinds) / 10, min(letters, 30) / 10, same, pairs if len(words) > 1 else 1.0, ended, upper, title, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, float(shares[0])]


class Network:
    """Two hidden layers of tanh units over standardised features; ``logit`` is the decision."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        a, b, c, d, e, f = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h1 = np.tanh(z @ a + b)
        h2 = np.tanh(h1 @ c + d)
        return [z, h1, h2, (h2 @ e + f)[:, 0]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradient(self, x: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        """Of sum(out * logit) by the weights."""
        z, h1, h2, _ = self.forward(x)
        _, _, c, _, e, _ = self.weights
        o = out[:, None]
        d2 = (o @ e.T) * (1 - h2**2)
        d1 = (d2 @ c.T) * (1 - h1**2)
        return [z.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ o, o.sum(0)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


SIZE, HIDDEN, ROWS, LEAST_STEPS = 512, 16, 1 << 15, 60


def begun(mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> Network:
    rng, d = np.random.default_rng(seed), len(mean)
    return Network(mean, scale, [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)])


def gradients(net: Network, p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Of the non-negative risk on trusted ``p`` and unlabelled ``u``; without a prior, of the plain logistic loss of one against the other."""
    gp, gu = net.logit(p), net.logit(u)
    if prior is None:
        return [a + b for a, b in zip(net.gradient(p, -_sigmoid(-gp) / len(p)), net.gradient(u, _sigmoid(gu) / len(u)), strict=True)]
    back = [a + b for a, b in zip(net.gradient(u, _sigmoid(gu) / len(u)), net.gradient(p, -prior * _sigmoid(gp) / len(p)), strict=True)]
    if _softplus(gu).mean() - prior * _softplus(gp).mean() >= 0:
        return [a + b for a, b in zip(net.gradient(p, -prior * _sigmoid(-gp) / len(p)), back, strict=True)]
    return [-b for b in back]


def steps(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float | None, rate: float, rng: np.random.Generator) -> None:
    """Moves the network by Adam's rule, as many steps as the rows of ``unl`` fill, ``LEAST_STEPS`` at least."""
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, max(LEAST_STEPS, -(-len(unl) // SIZE)) + 1):
        grads = gradients(net, pos[rng.integers(0, len(pos), SIZE)], unl[rng.integers(0, len(unl), SIZE)], prior)
        for k, g in enumerate(grads):
            g = g + 1e-4 * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)


def _measures(x: pa.RecordBatch) -> np.ndarray:
    return x.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _gathered(batches):
    """The measures of a task's rows, ``ROWS`` at a time."""
    held, n = [], 0
    for x in batches:
        held.append(_measures(x))
        n += len(held[-1])
        if n >= ROWS:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _summed(measured: DataFrame, run) -> list[np.ndarray]:
    """What ``run`` gives of each task, in an order that doesn't depend on the tasks'."""
    return [np.array(r) for r in sorted(tuple(r[0]) for r in measured.mapInArrow(run, "x array<double>").collect())]


_NUMBERS = pa.schema([("x", pa.list_(pa.float64()))])


def trained(measured: DataFrame, pos: np.ndarray, net: Network, prior: float | None, rounds: int) -> Network:
    """Rounds of steps in every task of ``measured`` (one column of measures) and means of their weights."""
    shapes = [w.shape for w in net.weights]
    trusted = measured.sparkSession.sparkContext.broadcast(pos)  # bounded rows; in each round's function they would be sent anew
    for k in range(rounds):
        rate, common = 0.004 * (1 - 0.9 * k / rounds), net.weights

        @work("quality")
        def run(batches):
            total, n = 0.0, 0
            mine = Network(net.mean, net.scale, list(common))
            for unl in _gathered(batches):
                # the rows themselves seed their steps, so a task that runs twice gives the same
                steps(mine, trusted.value, unl, prior, rate, np.random.default_rng([k, len(unl), int(abs(unl).sum() * 1000)]))
                n += len(unl)
                total = n * np.concatenate([w.ravel() for w in mine.weights])
            if n:
                yield batch(_NUMBERS, [np.concatenate([[n], total])])

        parts = _summed(measured, run)
        flat = sum(p[1:] for p in parts) / sum(p[0] for p in parts)
        net = Network(net.mean, net.scale, [w.reshape(s) for w, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)])
    trusted.unpersist()
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray, trusted: int, unlabelled: int, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled by best bin estimation, from the shares ``p`` of trusted and ``u`` of
    unlabelled rows that score at or above some thresholds."""
    slack = np.sqrt(np.log(4 / delta) / 2) * (unlabelled**-0.5 + trusted**-0.5)
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(measured: DataFrame, docs: DataFrame, labels: DataFrame, fold: F.Column, most_trusted: int = 15_000, rounds: int = 8) -> tuple[Network | None, float]:
    """(network, prior) from the rows of ``measured`` (held_out, x) that aren't held out, all of them, and from
    at most ``most_trusted`` rows with label 1 of the fold."""

    @work("quality")
    def run(batches):
        for x in pieces(batches, 1000):
            yield batch(_NUMBERS, [form(t) for t in texts(x.column(0))])

    trusted = labelled(docs, labels.where(F.col("quality") == 1), "quality", fold, most_trusted).select("text").mapInArrow(run, "x array<double>").collect()
    own = measured.where("not held_out").select("x")

    @work("quality")
    def moments(batches):
        total = np.zeros(1 + 2 * N_FEATURES)
        for x in _gathered(batches):
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield batch(_NUMBERS, [total])

    n, *sums = np.sum(_summed(own, moments) or [np.zeros(1 + 2 * N_FEATURES)], axis=0)
    if not trusted or not n:
        return None, 1.0
    # Spark promises no order; sorted rows make the fit repeatable
    pos = np.array(sorted(tuple(r[0]) for r in trusted))
    mean = np.array(sums[:N_FEATURES]) / n
    scale = np.sqrt(np.maximum(np.array(sums[N_FEATURES:]) / n - mean**2, 0)) + 1e-3
    first = trained(own, pos, begun(mean, scale), None, max(2, rounds // 2))
    scores = first.logit(pos)
    cuts = np.unique(np.quantile(scores, np.linspace(0, 0.99, 200)))

    @work("quality")
    def above(batches):
        total = np.zeros(len(cuts))
        for x in _gathered(batches):
            total += len(x) - np.searchsorted(np.sort(first.logit(x)), cuts, side="left")
        yield batch(_NUMBERS, [total])

    prior = estimate_prior((scores[None, :] >= cuts[:, None]).mean(1), np.sum(_summed(own, above), axis=0) / n, len(pos), int(n))
    return trained(own, pos, begun(mean, scale), prior, rounds), prior


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Labels teach only where crc32(doc_id) mod 5 isn't 0, at most 15,000 of them; all other
    rows of that fold are unlabelled and teach as such. Null texts count as empty and are
    scored; null ids are never held out; repeated rows are scored alike; without trusted
    labels every score is 0.5; an empty table gives no row; other columns are ignored; a very
    long text is measured whole. The measures of all rows, 20 numbers each, are kept in the
    shared folder.
    """
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    measure = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float32()))])

    @work("quality")
    def run(batches):
        for x in pieces(batches, 1000):
            yield batch(measure, x.column(0), x.column(1), [form(t) for t in texts(x.column(2))])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    measured = written(d.mapInArrow(run, "doc_id long, held_out boolean, x array<float>"), "measures")
    net, _ = fit(measured, docs, labels, crc_of_id() % 5 != 0)

    @work("quality")
    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
        for x in batches:
            f = _measures(x.select([2]))
            yield batch(schema, x.column(0), x.column(1), _sigmoid(net.logit(f)) if net else np.full(len(f), 0.5))

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
