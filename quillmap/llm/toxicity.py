"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: terms that stand out in documents labelled toxic. It is kept
as a trie and intersected with the Levenshtein automata of its terms; the product is
made deterministic state by state as words need it, so a word costs one table step a
letter and misspelled terms are met without listing their variants. Each match is
then read in its context: quotation marks and words of reporting around it speak for
quotation, words of address, exclamation marks and further matches for abuse. A
logistic model over these counts gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+(?:[@$*!|]+\w+)*")
#: Fixed word lists of four languages: reporting and address.
REPORTS = frozenset("said says wrote quoted called quote reported dit disait écrit cité sagte schrieb zitiert nannte dijo escribió citó llamó".split())
ADDRESS = frozenset("you your youre ya du dich dein ihr euch tu toi ton vous votre tú usted tus eres".split())
QUOTES = re.compile("[\"«»“”„]")
SPELT = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "*": ""})
SPAN = 8
#: Pairs of trie node and edits that the states of an automaton hold before they are made anew.
STATE_PAIRS = 400_000


def edits(term: str) -> int:
    """Edits by which a misspelling may differ from a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class State:
    """A state of the product: its pairs, what a word that ends here matches, and the states that letters lead to."""

    __slots__ = ("pairs", "found", "after")

    def __init__(self, pairs: frozenset, found: tuple[str, int] | None):
        self.pairs, self.found, self.after = pairs, found, {}


class Automaton:
    """The lexicon's trie intersected with its terms' Levenshtein automata.

    A state is a set of (trie node, edits spent), each node with its fewest edits, kept as
    one number a pair, the edits in its last two bits. A node may spend as many edits as the most tolerant term below it.
    """

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.may: list[int] = [0]
        for term in terms:
            at, may = 0, edits(term)
            self.may[0] = max(self.may[0], may)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.may.append(0)
                at = self.next[at][c]
                self.may[at] = max(self.may[at], may)
            self.ends[at] = term
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, State] = {}
        self.held = 0
        self.first = self._state(self._closed({0: 0}))

    def _state(self, pairs: frozenset) -> State:
        """The one state of these pairs."""
        found = self.states.get(pairs)
        if found is None:
            ends = [(x & 3, t) for x in pairs if (t := self.ends[x >> 2]) is not None and x & 3 <= edits(t)]
            found = self.states[pairs] = State(pairs, (min(ends)[1], min(ends)[0]) if ends else None)
            self.held += len(pairs) + 1
        return found

    def _closed(self, spent: dict[int, int]) -> frozenset:
        """With the nodes that leaving out letters of a term reaches."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            e = spent[node] + 1
            for child in self.next[node].values():
                if e <= self.may[child] and e < spent.get(child, 99):
                    spent[child] = e
                    todo.append(child)
        return frozenset([node << 2 | e for node, e in spent.items()])

    def _step(self, state: frozenset, c: str) -> frozenset:
        spent: dict[int, int] = {}
        for x in state:
            node, e = x >> 2, x & 3
            if e < self.may[node] and e + 1 < spent.get(node, 99):
                spent[node] = e + 1
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.may[child] and cost < spent.get(child, 99):
                    spent[child] = cost
        return self._closed(spent) if spent else frozenset()

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, ties to the smaller term; None if there is none."""
        if self.held > STATE_PAIRS:
            self._forget()
        state = self.first
        for c in word:
            after = state.after.get(c)
            if after is None:
                after = state.after[c] = self._state(self._step(state.pairs, c))
            if not after.pairs:
                return None
            state = after
        return state.found


@dataclass
class Model:
    """Lexicon with severities, ordinary words (never misspellings), and the logistic weights."""

    terms: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(FEATURES)))


FEATURES = ("exact_abuse", "exact_quoted", "misspelt_abuse", "misspelt_quoted", "distinct", "density", "any_exact", "any_abuse")
_matchers: dict[int, tuple[Model, common.Cache]] = {}


def matcher(model: Model) -> common.Cache:
    """word -> None, or (term, edits); kept for the model at hand."""
    if id(model) not in _matchers:
        _matchers.clear()
        common.own("toxicity", _matchers.clear)
        automaton = Automaton(sorted(model.terms))

        def find(word: str):
            if word in model.terms:
                return word, 0
            if word in model.ordinary:
                return None
            plain = word if word.isalpha() else word.translate(SPELT)
            return automaton.match(plain) if plain else None

        _matchers[id(model)] = (model, common.Cache(find, 100_000))
    return _matchers[id(model)][1]


def matches(text: str, model: Model) -> list[tuple[int, int, str, int, float]]:
    """(start, end, term, edits, share of abuse) of every match in a text, in time that grows with the text alone."""
    find = matcher(model)
    lower = text.lower()
    words = WORD.findall(lower)
    hits = [i for i, w in enumerate(words) if find[w] is not None]
    if not hits:
        return []
    spans = [m.span() for m in WORD.finditer(lower)]
    marks = [m.start() for m in QUOTES.finditer(lower)]
    out = []
    for k, i in enumerate(hits):
        term, e = find[words[i]]
        a, b = spans[i]
        lo, hi = spans[max(0, i - SPAN)][0], spans[min(len(spans) - 1, i + SPAN)][1]
        within = lambda x, y: bisect_left(marks, x) < bisect_left(marks, y)
        near = words[max(0, i - SPAN) : i + SPAN + 1]
        others = k > 0 and i - hits[k - 1] <= SPAN or k + 1 < len(hits) and hits[k + 1] - i <= SPAN
        quote = 1.5 * (within(lo, a) and within(b, hi)) + 1.0 * any(w in REPORTS for w in near)
        abuse = 1.0 + 0.7 * any(w in ADDRESS for w in near) + 0.5 * ("!" in lower[b : b + 2]) + 0.5 * others
        out.append((a, b, term, e, abuse / (abuse + quote)))
    return out


def features(text: str, model: Model, found: list | None = None) -> list[float]:
    found = matches(text, model) if found is None else found
    if not found:
        return [0.0] * len(FEATURES)
    s = model.terms
    sums = [0.0] * 4
    for _, _, t, e, share in found:
        k = 2 * (e > 0)
        sums[k] += s[t] * share
        sums[k + 1] += s[t] * (1 - share)
    n = max(1, text.count(" ") + 1)
    return [min(3.0, np.log1p(x)) for x in sums] + [np.log1p(len({t for _, _, t, _, _ in found})), 10 * min(0.3, len(found) / n), float(any(e == 0 for *_, e, _ in found)), float(sums[0] + sums[2] > 0.5)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Weights, the intercept first, by Newton's method with a ridge on all but the intercept."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w, reg = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    reg[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + reg, x.T @ (y - p) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 10_000, least_odds: float = 12.0) -> Model:
    """A model from labelled rows whose crc32 of the id leaves no remainder 1 by 3.

    About `sample_docs` labelled documents are read (the bound of the sample). The
    lexicon holds all words whose odds in toxic documents, three of them at least, are
    `least_odds` times those elsewhere: a third of the words of the sample's toxic
    documents at most. Ordinary words of two clean documents never count as misspellings. The weights are fitted on one half
    of the sample with words learned from the other, so that words never seen before
    count as they will in use; the words of the final model come from both halves.

    Rows of null id or null label teach nothing, null texts read as empty, an id with
    several labels has their mean and one with several rows teaches by each. Without a
    toxic row to learn from the lexicon is empty and every text scores alike.
    """
    spark = docs.sparkSession
    ids = common.labelled_ids(labels, "toxic", 3, 1, sample_docs)
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    rows = common.written(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y", half.alias("half")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {"": [0, 0, 0, 0]}
        for batch in batches:
            for text, y, h in zip(common.texts(batch), batch.column("y").to_pylist(), batch.column("half").to_pylist()):
                for w in {"", *WORD.findall(text.lower())}:
                    seen.setdefault(w, [0, 0, 0, 0])[2 * h + y] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen))} | {c: pa.array([x[i] for x in seen.values()], pa.int64()) for i, c in enumerate(COUNTS)})

    words = common.written(rows.mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "toxicity-words")
    total = words.where("word = ''").first()
    if total is None:
        return Model({})
    first = _lexicon(words, total, ("clean0",), ("toxic0",), least_odds)
    final = _lexicon(words, total, ("clean0", "clean1"), ("toxic0", "toxic1"), least_odds)
    if not first.terms:
        return final
    shared = spark.sparkContext.broadcast(first)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, shared.value) for t in common.texts(batch)], pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    part = rows.where("half = 1").select("text", "y").mapInArrow(extract, "x array<double>, y int").toPandas()
    if part.y.nunique() == 2:
        final.weights = logistic(np.stack(part.x.to_numpy()), part.y.to_numpy(float))
    return final


COUNTS = ("clean0", "toxic0", "clean1", "toxic1")


def _lexicon(words: DataFrame, total, clean: tuple[str, ...], toxic: tuple[str, ...], least_odds: float) -> Model:
    n_clean, n_toxic = sum(total[c] for c in clean), sum(total[c] for c in toxic)
    if not n_clean or not n_toxic:
        return Model({})
    in_clean, in_toxic = sum((F.col(c) for c in clean[1:]), F.col(clean[0])), sum((F.col(c) for c in toxic[1:]), F.col(toxic[0]))
    odds = ((in_toxic + 0.2) / n_toxic) / ((in_clean + 0.2) / n_clean)
    found = words.where(F.length("word") >= 3)
    top = found.where((in_toxic >= 3) & (odds >= least_odds)).select("word", F.log(odds).alias("odds")).collect()
    model = Model({r["word"]: float(min(4.0, r["odds"])) for r in top})
    return Model(model.terms, frozenset(_near(found.where(in_clean >= 2), model))) if top else model


def _near(words: DataFrame, model: Model) -> list[str]:
    """Those of the words that the automaton would take for misspellings: the only ordinary words worth keeping."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            find = matcher(shared.value)
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w in batch.column("word").to_pylist() if w not in shared.value.terms and find[w]], pa.string())})

    return [r["word"] for r in words.select("word").mapInArrow(run, "word string").collect()]


def probability(text: str, model: Model, found: list | None = None) -> float:
    z = float(model.weights[0] + np.dot(model.weights[1:], features(text, model, found)))
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, n_matches) of every row, repeated rows included.

    Null and empty texts have no match and get the score of a text without one. Null
    ids stay null; other columns are not read; texts are read whole. Without toxic
    labels to learn from every score is 0.5 and nothing is predicted toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(probability(t, shared.value, found), len(found)) for t in common.texts(batch) for found in [matches(t, shared.value)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p for p, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())], ["doc_id", "score", "n_matches"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, score double, n_matches long")


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have no match and the score of a text without one; repeated rows
    stay and score alike, null ids stay null and are never held out, texts are read whole,
    other columns are not read. An empty table gives no row.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score stays under the threshold; nothing is shuffled.

    Null and empty texts have no match and the score of a text without one; repeated rows
    stay or go together, null ids are as good as others, and columns may have any name. An
    empty table gives no row. Without toxic labels to learn from every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([probability(t, shared.value) < threshold for t in common.texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
