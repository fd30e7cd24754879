"""Benchmark decontamination by templates, windows and slots.

Words become template tokens: runs of numbers with their units and runs of names turn
into a typed placeholder each, everything else into its lower-case form without outer
punctuation. Any capital makes a name, save on common words; a second reading has no
names, for copies in other case and for items with capitals on most words. Windows of five
template tokens are looked up in a hash table of the benchmark's windows. Of the matches
of one item within one stretch of the document, the best alignment counts: both places
rise along it, and their difference changes seldom. An item leaks where the windows on
one alignment reach the share of its windows, and the same share of those that hold a
plain word, so that no list of numbers or names is evidence by itself; and where its
slots on that alignment are filled consistently: one value of the item always by one value
of the document, which a question with new numbers or names does and a chance likeness of
templates does not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

#: Fixed word list: units that follow a number.
UNITS = frozenset("km m cm mm mi mile miles ft feet foot inch inches kg g mg lb lbs pound pounds ton tons s sec second seconds min minute minutes h hour hours day days week weeks year years l ml litre litres liter liters gallon gallons usd eur dollar dollars euro euros cent cents percent % °c °f mph kmh volt volts watt watts".split())
NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-z]{1,2})?$", re.I)
SHARE = shingles.SIMILAR
#: Benchmark windows that one pass over the documents takes along: the broadcast's bound.
BLOCK_WINDOWS = 2_000_000
#: What a change of the alignment costs, in windows: next to nothing, and more than a chance window brings.
BENDS = (1e-6, 2.0)
#: Fixed word list: words that are no names though a sentence or a title gives them a capital.
COMMON = frozenset("a an the this that these those some any each every all both no one and or but if when while as because so than then though although in on at by for from of to into with without within after before during since until about above below over under between through per i you he she it we they his her its our their my your who whom whose what which where why how is are was were be been am do does did has have had can could will would shall should may might must not there here let find given suppose".split())
#: Titles and initials, after which a point does not part a name.
TITLES = frozenset("dr mr mrs ms st sr jr prof".split())
PLAIN, NUM, UNIT, CAPITAL = 0, 1, 2, 4
#: A mark after the word parts runs.
STOPS = 8
NAMES, NUMBERS, EXACT = 0, 1, 2
_slot = {k: np.uint64(shingles.word_hash[f"\x00{k}"]) for k in (NUM, CAPITAL)}


def _hash(word: str) -> int:
    """As shingles.word_hash, the last four bits free; most words are met once, and `_tokens` keeps them."""
    return xxhash.xxh3_64_intdigest(word) >> 1 & ~15


def _token(word: str) -> int:
    """Hash of the plain form, its last four bits the flags."""
    if word.isalpha() and word.islower():  # most words: nothing to strip, no number, no name
        return _hash(word) | (UNIT if word in UNITS else 0)
    core = word.strip(".,;:!?\"'()[]{}«»“”„…*_`|")
    low = core.lower()
    flags = STOPS if (word[-1:] in ".,;:!?" or word[-2:-1] in ".,;:!?") and not (len(core) == 1 and core.isalpha() or low in TITLES) else 0
    if core and NUMBER.match(core):
        flags = NUM if word[-1:] == "," else flags | NUM  # a comma doesn't part numbers
    elif low in UNITS:
        flags |= UNIT
    elif core[:1].isupper() and low not in COMMON:
        flags |= CAPITAL
    return _hash(low) | flags


_tokens = common.Cache(_token, 350_000)
_EMPTY = np.uint64(_hash(""))
_POWERS = np.array(shingles._POWERS)


def _forget() -> None:
    _tokens.clear()
    shingles.word_hash.clear()


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(plain hashes, flags) of a text's words."""
    words = text.split()
    both = np.fromiter(map(_tokens.__getitem__, words), np.uint64, len(words))
    return both & np.uint64(0xFFFFFFFFFFFFFFF0), (both & np.uint64(15)).astype(np.uint8)


def _read(plain: np.ndarray, flags: np.ndarray, reading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hashes, whether a slot, first word) of the tokens of one reading.

    A run of numbers and their units makes one token, and, in NAMES, a run of names,
    until a mark parts it; its value is that of all its words. What a word is depends
    on nothing but the word, and for a unit the number before it, so that an item and
    the document around its copy are read alike. NUMBERS has no names, EXACT no slots.
    """
    n = len(plain)
    if not n or reading == EXACT:
        return plain, plain, np.zeros(n, bool), np.arange(n)
    kind = np.zeros(n, np.uint8)
    if reading == NAMES:
        kind[(flags & CAPITAL) > 0] = CAPITAL
    number = (flags & NUM) > 0
    kind[number] = NUM
    kind[1:][((flags[1:] & UNIT) > 0) & number[:-1]] = NUM
    begins = np.ones(n, bool)
    begins[1:] = (kind[1:] == PLAIN) | (kind[1:] != kind[:-1]) | ((flags[:-1] & STOPS) > 0)
    first = np.flatnonzero(begins)
    kind, length = kind[first], np.diff(first, append=n)
    out, value = plain[first], plain[first]
    joined = length > 1
    if joined.any():
        place = np.arange(n) - np.repeat(first, length)
        value[joined] = shingles.mixed(np.add.reduceat(plain * _POWERS[place % len(_POWERS)], first)[joined])
    out[kind == CAPITAL], out[kind == NUM] = _slot[CAPITAL], _slot[NUM]
    return out, value, kind != PLAIN, first


def template(text: str, reading: int = NAMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hashes, whether a slot) of a text's tokens."""
    return _read(*_hashed(text), reading)[:3]


def readings(text: str) -> list[int]:
    """The readings by which an item is looked for: its words, numbers as slots, and names as slots too.

    A reading needs three plain words, or two in three, as all else would be a question
    with nothing but slots; an item without a plain word beside its numbers counts as it stands.
    """
    out = []
    for reading in (NAMES, NUMBERS):
        _, value, slot = template(text, reading)
        said = int((~slot & (value != _EMPTY)).sum())
        if said and (said >= 3 or 3 * said >= 2 * len(slot)):
            out.append(reading)
    return out if NUMBERS in out else [*out, EXACT]


@dataclass
class Reading:
    """Windows of a block of items in one reading: sorted hashes with item and place, and the items' values."""

    reading: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]
    slots: list[np.ndarray]
    ids: list[int]
    filter: np.ndarray
    lengths: tuple[int, ...]
    said: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, str]], reading: int) -> Reading:
        hashes, item, place, words, slots, ids, said = [], [], [], [], [], [], []
        for item_id, text in rows:
            t, values, slot = template(text, reading)
            if not len(t):
                continue
            w = shingles.windows(t)
            hashes.append(w)
            item.append(np.full(len(w), len(ids)))
            place.append(np.arange(len(w)))
            words.append(values)
            slots.append(slot)
            plain = np.concatenate(([0], np.cumsum(~slot & (values != _EMPTY))))
            said.append(plain[np.minimum(np.arange(len(w)) + shingles.WORDS, len(t))] > plain[: len(w)])
            ids.append(item_id)
        none = np.zeros(0, np.uint64)
        h, i, p = np.concatenate([none, *hashes]), np.concatenate([np.zeros(0, int), *item]), np.concatenate([np.zeros(0, int), *place])
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << 24, bool)
        seen[(h & np.uint64((1 << 24) - 1)).astype(np.int64)] = True
        return Reading(reading, h[order], i[order], p[order], words, slots, ids, np.packbits(seen), tuple(sorted({min(len(w), shingles.WORDS) for w in words})), said)

    def unpacked(self) -> np.ndarray:
        if not hasattr(self, "_seen"):
            common.own("decontaminate", _forget)
            self._seen = np.unpackbits(self.filter).astype(bool)
        return self._seen

    def leaks(self, hashed: tuple[np.ndarray, np.ndarray], share: float) -> list[tuple[int, float, int]]:
        """(item id, share of its windows, first word in the text) of every item that leaks into a text in this reading."""
        t, plain, _, first = _read(*hashed, self.reading)
        out: dict[int, tuple[float, int]] = {}
        for n in self.lengths:  # items under five words are one window of their own length
            if len(t) < n:
                continue
            w = shingles.windows(t, n)
            at = np.flatnonzero(self.unpacked()[(w & np.uint64((1 << 24) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, w[at], "left"), np.searchsorted(self.hashes, w[at], "right")
            n_each = hi - lo
            if not n_each.sum():
                continue
            k = np.repeat(lo, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            doc_at, items, places = np.repeat(at, n_each), self.item[k], self.place[k]
            for i in np.unique(items):
                if min(len(self.words[i]), shingles.WORDS) != n:
                    continue
                mine = items == i
                found = self._best(i, doc_at[mine], places[mine], plain, share)
                if found:
                    out[self.ids[i]] = max(found, out.get(self.ids[i], (0.0, 0)))
        return [(i, s, int(first[a])) for i, (s, a) in out.items()]

    def _best(self, i: int, doc_at: np.ndarray, places: np.ndarray, plain: np.ndarray, share: float) -> tuple[float, int] | None:
        words, slots, said = self.words[i], self.slots[i], self.said[i]
        total, spoken = max(1, len(words) - shingles.WORDS + 1), share * said.sum()

        def enough(some: np.ndarray) -> bool:
            some = np.unique(some)
            return len(some) >= share * total and said[some].sum() >= spoken

        if not enough(places):
            return None
        order = np.lexsort((places, doc_at))
        doc_at, places = doc_at[order], places[order]
        reach = int(1.25 * len(words)) + shingles.WORDS
        starts = np.flatnonzero(np.diff(doc_at, prepend=-1))
        best: tuple[float, int] | None = None
        for lo, hi in zip(starts.tolist(), np.searchsorted(doc_at, doc_at[starts] + reach, "right").tolist()):
            if best is not None and best[0] == 1:
                break
            if not enough(places[lo:hi]):
                continue
            for bend in BENDS:
                line = _alignment(doc_at[lo:hi].tolist(), places[lo:hi].tolist(), bend)
                if enough(np.array([p for _, p in line])) and (best is None or len(line) > best[0] * total) and self._consistent(words, slots, line, plain):
                    best = (len(line) / total, line[0][0])
        return best

    @staticmethod
    def _consistent(words: np.ndarray, slots: np.ndarray, line: list[tuple[int, int]], plain: np.ndarray) -> bool:
        """Whether the item's slot values go to one document value each along an alignment, and those to one of the item, for nine slots in ten."""
        if not slots.any():
            return True
        across: dict[int, dict[int, int]] = {}
        for d, p in line:
            for j in range(min(shingles.WORDS, len(words) - p, len(plain) - d)):
                if slots[p + j]:
                    votes = across.setdefault(p + j, {})
                    votes[d + j] = votes.get(d + j, 0) + 1
        pairs = [(int(words[p]), int(plain[max(votes, key=votes.__getitem__)])) for p, votes in across.items()]
        for one, other in ((0, 1), (1, 0)):
            by_value: dict[int, dict[int, int]] = {}
            for pair in pairs:
                row = by_value.setdefault(pair[one], {})
                row[pair[other]] = row.get(pair[other], 0) + 1
            if sum(max(r.values()) for r in by_value.values()) < 0.9 * len(pairs):
                return False
        return True


@dataclass
class Benchmark:
    """A block of items in every reading."""

    parts: list[Reading]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Benchmark:
        kinds = [(item_id, text, readings(text)) for item_id, text in rows if text and text.strip()]
        parts = [Reading.of([(i, t) for i, t, r in kinds if k in r], k) for k in (NAMES, NUMBERS, EXACT)]
        return Benchmark([x for x in parts if x.ids])

    def leaks(self, text: str, share: float = SHARE) -> list[tuple[int, float, int]]:
        """(item id, share of its windows, first word in the text) of every item that leaks into a text in any reading."""
        if not self.parts:
            return []
        hashed, out = _hashed(text), {}
        if len(hashed[0]):
            for part in self.parts:
                for i, s, a in part.leaks(hashed, share):
                    out[i] = max((s, a), out.get(i, (0.0, 0)))
        return sorted((i, s, a) for i, (s, a) in out.items())


def _alignment(doc_at: list[int], places: list[int], bend: float) -> list[tuple[int, int]]:
    """The (document place, item place) matches, both rising, that are most, less `bend` for every change of their difference.

    Matches come sorted by document place, then item place; for each document place the
    larger item places go first, so that none follows another of the same document place.
    """
    most: list[tuple[float, int]] = [(0.0, -1)] * (max(places) + 2)  # a Fenwick tree of prefix maxima over item places
    score, back, last = [0.0] * len(places), [-1] * len(places), {}
    for m in sorted(range(len(places)), key=lambda m: (doc_at[m], -places[m])):
        k, found = places[m], (0.0, -1)
        while k:
            found = max(found, most[k])
            k &= k - 1
        if found[1] >= 0:
            found = max((found[0] - bend, found[1]), (0.0, -1))
        same = last.get(doc_at[m] - places[m], -1)
        if same >= 0 and score[same] >= found[0]:
            found = (score[same], same)
        score[m], back[m] = found[0] + 1, found[1]
        last[doc_at[m] - places[m]] = m
        k = places[m] + 1
        while k < len(most):
            most[k] = max(most[k], (score[m], m))
            k += k & -k
    m, line = max(range(len(places)), key=score.__getitem__), []
    while m >= 0:
        line.append((doc_at[m], places[m]))
        m = back[m]
    return line[::-1]


def blocks(benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> Iterator[Benchmark]:
    """The benchmark in blocks of about `most` windows; null or empty items have none."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = rows.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)[\s\x1c-\x1f]+")) + 1)).first()[0] or 0
    count = max(1, -(-n // most))
    for k in range(count):
        yield Benchmark.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()])


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, items, best_share, first_word) for every row of docs(doc_id, text), repeated rows included.

    items are the item ids that leak into the text, ascending, empty for clean texts;
    best_share is the largest share of an item's windows (0 without a leak) and
    first_word the place of the first leaked window (null without). Null and empty texts
    leak nothing, null ids stay null, other columns are not read; texts are read whole.
    Blocks of `most` benchmark windows pass over the rows one after another and add to
    what a row carries; rows are written between them, so that a task holds one block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = "items array<long>, best_share double, first_word long"
    waiting = None
    for block in blocks(benchmark, most):
        if waiting is not None:
            before, rows = rows, common.written(rows.mapInArrow(_probe(spark, waiting, share, True), f"doc_id long, text string, {found}"), "leaks")
            common.dropped(before)
        waiting = block
    return rows.mapInArrow(_probe(spark, waiting, share, False), f"doc_id long, {found}")


def _probe(spark: SparkSession, block: Benchmark, share: float, keep_text: bool):
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.leaks(t, share) for t in common.texts(batch)]
            items, best, first = [[i for i, _, _ in x] for x in found], [max((s for _, s, _ in x), default=0.0) for x in found], [min((a for _, _, a in x), default=None) for x in found]
            if "items" in batch.schema.names:
                items = [sorted({*x, *y}) for x, y in zip(items, batch.column("items").to_pylist())]
                best = [max(x, y) for x, y in zip(best, batch.column("best_share").to_pylist())]
                first = [min((z for z in (x, y) if z is not None), default=None) for x, y in zip(first, batch.column("first_word").to_pylist())]
            kept = ["doc_id", "text"] if keep_text else ["doc_id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array(first, pa.int64())],
                [*kept, "items", "best_share", "first_word"],
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, into which no item leaks; nothing is shuffled, and rows are written between blocks of the benchmark.

    Null and empty texts leak nothing and stay; repeated rows stay or go together, null
    ids are as good as others, and columns may have any name. An empty table gives no row,
    an empty benchmark changes nothing.
    """
    held = None
    for k, block in enumerate(blocks(benchmark, most)):
        if k:
            before, held = held, common.written(docs, "clean")
            common.dropped(*filter(None, [before]))
            docs = held
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t, share) for t in common.texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
