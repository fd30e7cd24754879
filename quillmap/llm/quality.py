"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its potentials are linear in features of the line and of both
neighbours; a transition table ties adjacent labels. Forward and backward messages, kept
as good-to-bad ratios, give every line's marginal; the mean of the marginals, weighted
by line length, is the document's quality, calibrated by a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .toxicity import logistic

OWN = ("bias", "words", "word_length", "symbols", "pipes", "capitals", "distinct", "seen", "ends", "titles", "digits", "markup", "short", "runs", "small_words")
NEAR = tuple(OWN.index(x) for x in ("symbols", "pipes", "capitals", "distinct", "seen", "ends", "short"))
WIDTH = len(OWN) + 2 * len(NEAR)
#: Lines of a chain that is learned at once.
RUN = 256


def line_features(lines: list[str]) -> np.ndarray:
    """A row of features for each line: its own, then some of the previous and of the next line's."""
    own = []
    seen: set[str] = set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            own.append([1.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1.0, 0, 0])
            continue
        many = 1.0 / n
        count = line.count
        distinct = len(set(words)) * many
        own.append(
            [
                1.0, math.log1p(n) / 4, min(2.0, len(line) * many / 8),
                min(2.0, (count("#") + count("$") + count("%") + count("&") + count("*") + count("=") + count("~") + count("^")) * many),
                min(2.0, (count("|") + count("\t")) * many), min(1.0, 1.0 if line.isupper() else 0.3 * sum(map(str.isupper, words)) * many),
                distinct, float(line in seen), float(line.rstrip()[-1] in ".!?\"”»:"), sum(map(str.istitle, words)) * many,
                min(1.0, sum(map(str.isdigit, words)) * many), min(1.0, (count("<") + count("{") + count("http") + count("!!")) * many),
                float(n < 4), float(n > 6 and distinct < 0.3), sum([len(w) < 4 for w in words]) * many,
            ]
        )
        seen.add(line)
    x = np.array(own)
    near = x[:, NEAR]
    none = np.zeros((1, len(NEAR)))
    return np.hstack((x, np.vstack((none, near[:-1])), np.vstack((near[1:], none))))


@dataclass
class Field:
    """Weights of the good label over the bad one, the transition table's logarithms, and the calibration."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def marginals(self, lines: list[str]) -> list[float]:
        """P(good) of each line by forward-backward on ratios."""
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        phi = np.exp(np.clip(line_features(lines) @ self.weights, -30, 30)).tolist()
        ahead, a = [], 1.0
        for i, p in enumerate(phi):
            a = p if i == 0 else p * (a * gg + bg) / (a * gb + bb)
            a = min(1e12, max(1e-12, a))
            ahead.append(a)
        out, b = [0.0] * len(phi), 1.0
        for i in range(len(phi) - 1, -1, -1):
            z = ahead[i] * b
            out[i] = z / (1 + z)
            f = phi[i] * b
            b = min(1e12, max(1e-12, (gg * f + gb) / (bg * f + bb)))
        return out

    def mean(self, text: str) -> float:
        """Length-weighted mean marginal of a text's lines; a blank line counts one character."""
        lines = text.split("\n")
        n = [len(x) + 1 for x in lines]
        return sum(map(float.__mul__, self.marginals(lines), map(float, n))) / sum(n)

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * _logit(self.mean(text)))))))


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def _train(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by Adam; all documents' chains advance together."""
    order = sorted(range(len(x)), key=lambda i: -len(x[i]))
    x, y = [x[i] for i in order], [y[i] for i in order]
    n = np.array([len(v) for v in x])
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    flat, label = np.vstack(x), np.concatenate(y).astype(float)
    steps = int(n.max())
    live = [int((n > t).sum()) for t in range(steps)]
    w, moves = np.zeros(flat.shape[1]), np.zeros((2, 2))
    real = np.zeros((2, 2))
    for t in range(1, steps):
        a, b = label[first[: live[t]] + t - 1].astype(int), label[first[: live[t]] + t].astype(int)
        np.add.at(real, (a, b), 1)
    m = v = np.zeros(flat.shape[1] + 4)
    for k in range(1, rounds + 1):
        e = np.exp(moves)
        phi = np.exp(np.clip(flat @ w, -25, 25))
        ahead, back = np.empty(len(flat)), np.ones(len(flat))
        ahead[first] = phi[first]
        for t in range(1, steps):
            i = first[: live[t]] + t
            a = ahead[i - 1]
            ahead[i] = np.clip(phi[i] * (a * e[1, 1] + e[0, 1]) / (a * e[1, 0] + e[0, 0]), 1e-12, 1e12)
        for t in range(steps - 2, -1, -1):
            i = first[: live[t + 1]] + t
            f = phi[i + 1] * back[i + 1]
            back[i] = np.clip((e[1, 1] * f + e[1, 0]) / (e[0, 1] * f + e[0, 0]), 1e-12, 1e12)
        good = ahead * back / (1 + ahead * back)
        pair = np.zeros((2, 2))
        for t in range(1, steps):
            i = first[: live[t]] + t
            a, f = ahead[i - 1] / (1 + ahead[i - 1]), phi[i] * back[i]
            f = f / (1 + f)
            z = np.array([[(1 - a) * e[0, 0] * (1 - f), (1 - a) * e[0, 1] * f], [a * e[1, 0] * (1 - f), a * e[1, 1] * f]])
            pair += (z / z.sum((0, 1))).sum(2)
        grad = np.concatenate((flat.T @ (label - good), (real - pair).ravel())) / len(flat) - ridge * np.concatenate((w, 10 * moves.ravel()))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, moves = w + step[:-4], moves + step[-4:].reshape(2, 2)
    return Field(w, moves)


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(text, y) of the sampled documents, whole, as many as have about `most` lines together, in a fixed pseudo-random order.

    A document of more lines than that has no place in the sample.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    lines = rows.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("n")).where(F.col("n") <= most)
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = lines.withColumn("before", before).where(F.col("before") <= most).select(F.col("doc_id").alias("chosen"))  # a row for each sampled document
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_lines: int = 200_000) -> Field:
    """A field from labelled rows whose crc32 of the id leaves a remainder by 5.

    About `sample_docs` labelled documents are read, whole, and as many of them as have
    `sample_lines` lines together (the bounds of the sample). Lines take their document's label; then, once, lines of
    bad documents that the field takes for good are learned as good, unless all would be.
    Long documents are learned in runs of RUN lines, whose features see the lines around;
    the calibration takes whole documents.

    Rows of null id or null label teach nothing, null texts read as empty, an id with
    several labels has their mean and one with several rows teaches by each. Without
    labelled rows every text scores alike.
    """
    ids = common.labelled_ids(labels, "quality", 5, 0, sample_docs)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = [], []
            for text in common.texts(batch):
                lines = text.split("\n")
                x.append(line_features(lines).astype(np.float32).ravel())
                size.append(np.array([len(s) + 1 for s in lines], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), pa.array(size, pa.list_(pa.float32())), batch.column("y")], ["x", "size", "y"])

    part = _sample(docs, ids, sample_lines).mapInArrow(extract, "x array<float>, size array<float>, y int").toPandas()
    if part.y.nunique() < 2:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, 0.0))
    whole = [np.asarray(v, float).reshape(-1, WIDTH) for v in part.x]
    runs = [(v[a : a + RUN], k) for v, k in zip(whole, part.y) for a in range(0, len(v), RUN)]
    x, kinds = [v for v, _ in runs], [k for _, k in runs]
    y = [np.full(len(v), k) for v, k in runs]
    field = _train(x, y)
    for i, k in enumerate(kinds):
        if not k:
            good = (x[i] @ field.weights) > 1.0
            if good.any() and not good.all():
                y[i] = good.astype(int)
    field = _train(x, y)
    means = [np.average(_chain(field, v), weights=s) for v, s in zip(whole, part["size"])]
    field.curve = tuple(logistic(np.array([[_logit(p)] for p in means]), part.y.to_numpy(float), ridge=0.5))
    return field


def _chain(field: Field, x: np.ndarray) -> np.ndarray:
    e = np.exp(field.moves)
    phi = np.exp(np.clip(x @ field.weights, -30, 30))
    ahead, back = phi.copy(), np.ones(len(phi))
    for t in range(1, len(phi)):
        ahead[t] = np.clip(phi[t] * (ahead[t - 1] * e[1, 1] + e[0, 1]) / (ahead[t - 1] * e[1, 0] + e[0, 0]), 1e-12, 1e12)
    for t in range(len(phi) - 2, -1, -1):
        f = phi[t + 1] * back[t + 1]
        back[t] = np.clip((e[1, 1] * f + e[1, 0]) / (e[0, 1] * f + e[0, 0]), 1e-12, 1e12)
    return ahead * back / (1 + ahead * back)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, n_lines) of every row of docs(doc_id, text), repeated rows included.

    A null or empty text is one blank line. Null ids stay null; other columns are not
    read; texts are read whole. Without labels of both kinds every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("quality")
        for batch in batches:
            whole = common.texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.score(t) for t in whole], pa.float64()), pa.array([t.count("\n") + 1 for t in whole], pa.int64())], ["doc_id", "score", "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_lines long")


def lines(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, line, p_good, text) of every line of docs(doc_id, text), lines numbered from 0.

    A null or empty text is one blank line. Null ids stay null, repeated rows give their
    lines each time, other columns are not read; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("quality")
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                parts = text.split("\n")
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(parts), pa.int64()), "line": pa.array(range(len(parts)), pa.int64()), "p_good": pa.array(shared.value.marginals(parts), pa.float64()), "text": pa.array(parts, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line long, p_good double, text string")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are one empty line; repeated rows stay and score alike, null ids
    stay null and are never held out, texts are read whole, other columns are not read. An
    empty table gives no row.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", common.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
