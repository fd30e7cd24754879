"""Language identification with language-bitmask n-gram filters.

Every letter n-gram of a language's training texts goes into a Bloom filter. The
filters of up to sixteen languages are bit-sliced: one table of 16-bit words, bit l
of a slot belonging to language l, so the AND of a gram's k slots is the mask of all
languages that (probably) hold it. A text is scored by counting, per language, the
grams whose mask has its bit, and by taking off the hits that chance alone gives:
with false-positive rate f, `h` hits of `n` grams stand for (h - n f) / (1 - f).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS = (3, 4)
SLICE = 16
WINDOW = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))
NONE = np.zeros(0, np.uint64)
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point -> lower-case code point, or a space for whatever is no letter."""
    if not _letters:
        lower = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                lower[c] = ord(s.lower()[0])
        _letters.append(lower)
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, each run of anything else one space, a space at either end."""
    points = _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate((np.array([32], np.uint32), points, np.array([32], np.uint32)))
    gap = points == 32
    return points[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]


def grams_of(points: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the GRAMS of a letter sequence of any length, at most WINDOW at a time, each gram once."""
    for n in GRAMS:
        for a in range(0, len(points) - n + 1, WINDOW):
            x = points[a : a + WINDOW + n - 1].astype(np.uint64)
            h = np.full(len(x) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * _MIX[0] + x[i : len(x) - n + 1 + i]
            h ^= h >> np.uint64(29)
            h *= _MIX[1]
            h ^= h >> np.uint64(32)
            yield h


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: tables[s] holds the languages 16 s .. 16 s + 15."""

    langs: list[str]
    tables: list[np.ndarray]
    hashes: int
    rates: np.ndarray

    @staticmethod
    def build(langs: list[str], grams: dict[str, np.ndarray], hashes: int = 3, slots_per_gram: int = 12) -> LanguageFilters:
        most = max((len(g) for g in grams.values()), default=0)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most * slots_per_gram)))))
        tables, rates = [], []
        for s in range(0, len(langs), SLICE):
            t = np.zeros(size, np.uint16)
            for bit, lang in enumerate(langs[s : s + SLICE]):
                for at in slots(grams[lang], size, hashes):
                    t[at] |= np.uint16(1 << bit)
                rates.append(((t >> np.uint16(bit)) & np.uint16(1)).mean() ** hashes)
            tables.append(t)
        return LanguageFilters(langs, tables, hashes, np.array(rates))

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """How many of the grams each language's filter holds."""
        out = []
        at = slots(grams, len(self.tables[0]), self.hashes)
        for s, t in enumerate(self.tables):
            mask = t[at[0]]
            for a in at[1:]:
                mask &= t[a]
            by_mask = np.bincount(mask)
            values = np.arange(len(by_mask))
            out += [int(by_mask[(values >> bit) & 1 == 1].sum()) for bit in range(min(SLICE, len(self.langs) - s * SLICE))]
        return np.array(out)

    def predict(self, text: str) -> tuple[str, float]:
        points = letters(text)
        if not (points != 32).any() or not self.langs:
            return "und", 0.0
        n, hit = 0, np.zeros(len(self.langs))
        for grams in grams_of(points):
            n += len(grams)
            hit += self.hits(grams)
        share = np.clip((hit - n * self.rates) / (1 - self.rates), 0, n) / max(n, 1)
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum()) if share.sum() else 0.0


def slots(grams: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in range(hashes)]


def fit(docs: DataFrame, sample_docs: int = 1500, min_docs: int = 2, least_share: float = 0.125) -> LanguageFilters:
    """Filters of the languages in docs(doc_id, text, lang).

    At most about `sample_docs` documents a language are read, chosen by a hash of
    doc_id (the bound of the sample). A gram enters the filter of a language where at
    least `min_docs` of its documents hold it and their share is at least
    `least_share` of the largest share among the languages, so that foreign passages
    in a text don't spread one language's grams over all filters; a language with fewer
    documents than `min_docs` enters with the grams of what it has. The sample bounds the
    filters' size; there is a filter for every language.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("of"))
    counts = {r["lang"]: r["of"] for r in sizes.collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageFilters([], [np.zeros(1024, np.uint16)], 3, np.zeros(0))
    some = docs.join(F.broadcast(sizes.withColumnRenamed("lang", "l")), F.col("lang") == F.col("l"))  # a row for each language
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000.0 * sample_docs) / F.col("of")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(common.texts(batch), batch.column("lang").to_pylist()):
                seen.setdefault(lang, []).append(np.unique(np.concatenate([NONE, *grams_of(letters(text))])))
                n[lang] = n.get(lang, 0) + 1
        for lang, sets in seen.items():
            grams, found = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(grams) + 1)), "gram": pa.array(np.append(grams.view(np.int64), 0)), "n": pa.array(np.append(found, 0)), "docs": pa.array(np.append(np.zeros(len(grams), np.int64), n[lang]))})

    sampled = some.mapInArrow(count, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    few = [lang for lang in langs if counts[lang] < min_docs]
    rows = sampled.where((F.col("n") >= min_docs) | (F.col("docs") > 0) | F.col("lang").isin(few)).toPandas()
    totals = {lang: float(rows.docs[rows.lang == lang].sum()) for lang in langs}
    rows = rows[(rows.n >= min_docs) | (rows.n > 0) & rows.lang.isin(few)].assign(share=lambda x: x.n / x.lang.map(totals).clip(lower=1))
    top = rows.groupby("gram").share.transform("max")
    rows = rows[rows.share >= least_share * top].sort_values("share", ascending=False, kind="stable")
    return LanguageFilters.build(langs, {lang: rows.gram[rows.lang == lang].to_numpy().view(np.uint64) for lang in langs})


def predict(docs: DataFrame, filters: LanguageFilters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of docs, repeated rows included.

    Null texts, empty texts and texts without a letter give `und` with score 0; so
    does a model without languages. Where no gram is known the first language in
    code-point order is given with score 0; ties go to that order too. Null ids stay
    null; other columns are not read. Texts are read whole, in windows of bounded size.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("language")
        found = model.value
        for batch in batches:
            out = [found.predict(t) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on rows that aren't held out, predict for all: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0; rows of null id are
    never held out, rows of null lang teach nothing. Repeated rows stay; ties go to the
    first language in order, also between languages whose filters hold no gram, as that of
    a language of two documents or more without a gram in common. An empty table, or one
    without a lang to learn, gives `und` throughout, or no row.
    """
    filters = fit(docs.where(~common.held_out("doc_id", 4, 2)))
    return predict(docs, filters).withColumn("held_out", common.held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")
