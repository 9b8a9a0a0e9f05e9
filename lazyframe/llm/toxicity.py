"""Toxicity by a lexicon trie met with Levenshtein automata, and scores of what stands around a hit.

The lexicon is learned: words and word beginnings that occur in many different toxic
texts and hardly in others. All words within a distance of a term are accepted by one
automaton, the meeting of the trie with the automata of the terms; its states are sets
of (trie node, edits spent) and are made when a text first leads there, so a word that is
near no term costs a few steps. A hit counts by its distance and by its window: between
quotation marks or next to words of reporting it counts as quoted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, crc_of_id, pieces, texts, with_texts, work

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]")
#: Marks of quotation and words of reporting in the four languages.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says quote quoted wrote called term word sagte sagt wort zitat dit disait mot cité dijo dice palabra cita".split())
WINDOW = 40
SHORTEST_FUZZY = 5
FEATURES = 7
#: Words and states of the automaton that a worker remembers; beyond it they are forgotten and found anew.
MOST_WORDS, MOST_STATES = 150_000, 100_000
#: Longer words are looked at anew each time, so what is remembered stays small.
LONGEST_KEPT = 40
#: The state after so many letters of a word is remembered.
HEAD = 4
#: Up to so many different hits are looked up one by one in a text, more by one walk over its words.
FEW = 8


class _State(dict):
    """Letter -> next state, or None where no term is near any longer; made when first asked for.

    ``places``: (trie node, edits spent); ``stem``: the best weight of a stem that ends here;
    ``end``: (edits, -weight) of the best term that ends here.
    """

    __slots__ = ("end", "machine", "places", "stem")

    def __missing__(self, c: str) -> _State | None:
        got = self[c] = self.machine._step(self, c)
        return got


class Machine:
    """Accepts words within ``reach(term)`` edits of a whole term, and words that begin with a stem.

    ``terms``: term -> weight; a term that ends in ``*`` is a stem and is met exactly.
    """

    def __init__(self, terms: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[float, int]] = {}
        self.stems: dict[int, float] = {}
        for term, weight in terms.items():
            stem, node = term.endswith("*"), 0
            for c in term.removesuffix("*"):
                if c not in self.next[node]:
                    self.next.append({})
                    self.next[node][c] = len(self.next) - 1
                node = self.next[node][c]
            if stem:
                self.stems[node] = weight
            else:
                self.ends[node] = (weight, 2 if len(term) >= 9 else int(len(term) >= SHORTEST_FUZZY))
        self.reach = [0] * len(self.next)  # the most edits that any term below a node allows
        for node in range(len(self.next) - 1, -1, -1):
            self.reach[node] = max([self.ends.get(node, (0, 0))[1], *(self.reach[k] for k in self.next[node].values())])
        self.terms = terms
        self.known: dict[str, tuple[float, int]] = {}  # of words near a term
        self.clean: set[str] = set()  # words near no term
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.heads: dict[str, tuple[_State | None, tuple[float, int] | None]] = {}
        self.start = self._state(self._skipped({0: 0}))

    def _skipped(self, found: dict[int, int]) -> dict[int, int]:
        """With the places reached by leaving out letters of the term."""
        todo = list(found)
        while todo:
            node = todo.pop()
            for k in self.next[node].values():
                e = found[node] + 1
                if e <= self.reach[k] and e < found.get(k, 9):
                    found[k] = e
                    todo.append(k)
        return found

    def _state(self, found: dict[int, int]) -> _State:
        key = tuple(sorted(found.items()))
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State()
            state.machine, state.places = self, key
            state.stem = max((self.stems[node] for node, e in key if e == 0 and node in self.stems), default=None)
            state.end = min(((e, -self.ends[node][0]) for node, e in key if node in self.ends and e <= self.ends[node][1]), default=None)
        return state

    def _step(self, state: _State, c: str) -> _State | None:
        found: dict[int, int] = {}
        for node, e in state.places:
            for letter, k in self.next[node].items():
                cost = e + (letter != c)
                if (cost == 0 or cost <= self.reach[k]) and cost < found.get(k, 9):
                    found[k] = cost
            if e + 1 <= self.reach[node] and e + 1 < found.get(node, 9):
                found[node] = e + 1
        return self._state(self._skipped(found)) if found else None

    def _walk(self, state: _State | None, best: tuple[float, int] | None, letters: str) -> tuple[_State | None, tuple[float, int] | None]:
        """The state after ``letters`` (None: no term is near any longer), and the best stem passed."""
        if state is not None:
            for c in letters:
                state = state[c]
                if state is None:
                    break
                if state.stem is not None and (best is None or state.stem > best[0]):
                    best = (state.stem, 0)
        return state, best

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, distance) of the best term, or None."""
        if word in self.known:
            return self.known[word]
        if len(self.states) > MOST_STATES:
            self._begin()
        head = word[:HEAD]
        at = self.heads.get(head)
        if at is None:
            at = self._walk(self.start, None, head)
            if len(self.heads) >= MOST_WORDS:
                self.heads.clear()
            self.heads[head] = at
        state, best = at if at[0] is None or len(word) <= HEAD else self._walk(*at, word[HEAD:])
        if state is not None and state.end is not None:
            e, weight = state.end[0], -state.end[1]
            if best is None or (e, -weight) < (best[1], -best[0]):
                best = (weight, e)
        if best is not None and len(word) <= LONGEST_KEPT:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[word] = best
        return best

    def matches(self, low: str) -> dict[str, tuple[float, int]]:
        """word -> (weight, distance) of the different words of a text, in lower case, that are near a term."""
        out: dict[str, tuple[float, int]] = {}
        clean = []
        for word in set(WORD.findall(low)) - self.clean:
            best = self.match(word)
            if best is not None:
                out[word] = best
            elif len(word) <= LONGEST_KEPT:
                clean.append(word)
        if len(self.clean) + len(clean) > MOST_WORDS:
            self.clean.clear()
        self.clean.update(clean[:MOST_WORDS])
        return out


_KEPT: list[Machine] = []


def _forget() -> None:
    _KEPT.clear()


def machine_of(terms: dict[str, float]) -> Machine:
    """The worker's machine of these terms, kept from task to task until the worker turns to another operator."""
    if not _KEPT or _KEPT[0].terms != terms:
        _KEPT[:] = [Machine(terms)]
    return _KEPT[0]


def _places(low: str, words) -> list[tuple[int, int]]:
    """(start, end), in order, wherever one of ``words`` stands as a whole word."""
    if len(words) > FEW:
        return [m.span() for m in WORD.finditer(low) if m[0] in words]
    out = []
    for word in words:
        start = low.find(word)
        while start >= 0:
            end = start + len(word)
            before, after = low[start - 1 : start], low[end : end + 1]
            if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                out.append((start, end))
            start = low.find(word, end)
    return sorted(out)


def spans(text: str, machine: Machine) -> list[tuple[int, int, float, int, bool]]:
    """(start, end, weight, distance, quoted) of the hits in a text."""
    low = text.lower()
    hits = machine.matches(low)
    out = []
    for start, end in _places(low, hits) if hits else ():
        left, right = SENTENCE.split(low[max(0, start - WINDOW) : start])[-1], SENTENCE.split(low[end : end + WINDOW])[0]
        marks = any(c in QUOTES for c in left) and any(c in QUOTES for c in right)
        told = not REPORTING.isdisjoint(WORD.findall(left)[-3:])
        out.append((start, end, *hits[low[start:end]], marks or told))
    return out


def features(text: str, machine: Machine) -> list[float]:
    hits = spans(text, machine)
    plain = [h for h in hits if h[3] == 0 and not h[4]]
    fuzzy = [h for h in hits if h[3] > 0 and not h[4]]
    quoted = [h for h in hits if h[4]]
    return [float(bool(plain)), float(np.log1p(len(plain))), max((h[2] for h in plain), default=0.0), float(bool(fuzzy)), float(np.log1p(len(fuzzy))), float(np.log1p(len(quoted))), float(np.log1p(len(text)) / 10)]


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: F.Column, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled rows of the training fold, those of the least hash.

    The ids (at most ``most``) are broadcast; the texts aren't shuffled. Rows without id,
    label or text, and labels other than 0 and 1, teach nothing.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & fold)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most)
    )
    rows = [(r[0], r[1]) for r in chosen.collect()]  # bounded by ``most``
    spark = docs.sparkSession
    table = spark.createDataFrame(rows, "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(table), "doc_id")


@work("toxicity", _forget)
def _evidence(batches):
    """A word or a beginning of one, the label, and a sketch of the text that near copies mostly share."""
    schema = pa.schema([("term", pa.string()), ("y", pa.int32()), ("sketch", pa.int64())])
    for x in pieces(batches, 500):
        terms, ys, sketches = [], [], []
        for y, text in zip(x.column(0).to_pylist(), texts(x.column(1)), strict=True):
            words = set(WORD.findall(text.lower()))
            if not words:
                continue
            sketch = min(zlib.crc32(w.encode()) for w in words)
            found = words | {f"{w[:k]}*" for w in words for k in (4, 5, 6) if len(w) >= k + 1}
            terms += found
            ys += [y] * len(found)
            sketches += [sketch] * len(found)
        yield batch(schema, terms, ys, sketches)


def learn_lexicon(sample: DataFrame, least: int = 3, least_ratio: float = 12.0) -> dict[str, float]:
    """term -> log odds, of words and stems (``abc*``) that mark toxic texts.

    Support is counted in different sketches, so copies of one text count once. Counted
    on the executors; only terms that pass reach the driver, which the bounded sample bounds.
    """
    counts = sample.select("y", "text").mapInArrow(_evidence, "term string, y int, sketch long").distinct().groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    sizes = sample.groupBy("y").count().collect()
    n = {r[0]: r[1] for r in sizes}
    good, bad = n.get(0, 0), n.get(1, 0)
    if not bad:
        return {}
    odds = F.log((F.col("bad") + 0.1) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    rows = counts.where(F.col("bad") >= least).select("term", "bad", odds.alias("w")).where(F.col("w") >= float(np.log(least_ratio))).orderBy(F.desc("bad"), F.desc("w"), "term").collect()
    terms: dict[str, float] = {}
    stems = {r["term"]: r["bad"] for r in rows if r["term"].endswith("*")}
    below: dict[str, int] = {}  # of a beginning, the support of the most frequent word
    for r in rows:
        for k in (4, 5, 6) if not r["term"].endswith("*") else ():
            below[r["term"][:k]] = max(r["bad"], below.get(r["term"][:k], 0))
    for r in rows:
        t = r["term"]
        if t.endswith("*"):
            # a stem must say more than the most frequent word below it, and isn't needed below a shorter one
            top = below.get(t[:-1], 0)
            shorter = any(f"{t[:k]}*" in stems and stems[f"{t[:k]}*"] >= 0.9 * r["bad"] for k in range(4, len(t) - 1))
            if r["bad"] >= 1.5 * top and not shorter:
                terms[t] = r["w"]
        else:
            terms[t] = r["w"]
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method, drawn to ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(x) * 0.01 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge * len(x) * 0.01 + 1e-6)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Where nothing is learned: a plain hit makes a text toxic, a misspelled one likely, a quoted one hardly.
PRIOR = np.array([3.0, 1.0, 0.2, 1.5, 0.7, 0.4, 0.0, -3.0])


def train(docs: DataFrame, labels: DataFrame, fold: F.Column, most: int = 30_000) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from at most ``most`` labelled rows of the fold."""
    sample = labelled(docs, labels, "toxic", fold, most).persist()
    terms = learn_lexicon(sample)

    @work("toxicity", _forget)
    def run(batches):
        machine = machine_of(terms)
        for x in pieces(batches, 1000):
            yield batch(pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))]), x.column(0), [features(t, machine) for t in texts(x.column(1))])

    rows = sample.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    sample.unpersist()
    if not rows or len({r[0] for r in rows}) < 2:
        return terms, PRIOR
    return terms, fit_logistic(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float), PRIOR)


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Labels teach only where crc32(doc_id) mod 4 isn't 2. Null texts count as empty and get
    the score of a text without hits; null ids are never held out; repeated rows are scored
    alike; without labels the prior weights and an empty lexicon hold; other columns are ignored;
    an empty table gives no row. A very long text is read whole, by its different words first.
    """
    terms, weights = train(docs, labels, crc_of_id() % 4 != 2, most_labelled)

    @work("toxicity", _forget)
    def run(batches):
        machine = machine_of(terms)
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
        for x in pieces(batches, 1000):
            yield batch(schema, x.column(0), x.column(1), scores(texts(x.column(2)), machine, weights))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def scores(many: list[str], machine: Machine, weights: np.ndarray) -> np.ndarray:
    f = np.array([features(t, machine) for t in many]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic; see ``score_toxicity``."""
    terms, weights = train(docs, labels, crc_of_id() % 4 != 2)
    d, at, width = with_texts(docs)

    @work("toxicity", _forget)
    def clean(batches):
        machine = machine_of(terms)
        for x in pieces(batches, 1000):
            yield x.filter(pa.array(scores(texts(x.column(at)), machine, weights) < 0.3)).select(list(range(width)))

    return d.mapInArrow(clean, docs.schema)
