"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or
insertion makes of it, over the letters that the vocabulary holds; those that are words
are found by an equi-join on the string itself, so no distance is ever computed. Strings
are distinct by rule: of a run of equal letters one is deleted, a letter is not replaced
by itself, and a letter is not inserted before an equal one.

A word emits some hundred to thousand strings, of which a few are words. They are made as
64-bit polynomial hashes of whole columns of words and looked up in a Bloom filter of the
vocabulary first; only those that pass become strings and are shuffled. The filter has 32
bits a word and 64 MB at most; beyond that more strings pass, and the join still decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of a text that are searched at a time, distinct words that a task holds, words whose strings are made at a time.
PIECE, HELD, AT_ONCE = 1 << 20, 200_000, 512
LEAST_BITS, MOST_BITS, BITS_A_WORD, PROBES = 16, 29, 32, 3
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]
#: A 64-bit number for each of the code points up to 255.
LETTER = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower(run: str) -> str:
    """A to Z in lower case, all other letters as they are."""
    return run.lower() if run.isascii() else "".join(c.lower() if c.isascii() else c for c in run)


def runs(text: str) -> Iterator[str]:
    """The maximal runs of letters, found piece by piece, so that no list of all of a long text is made."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            last = RUN.match(text, stop - 1)
            stop = max(stop, last.end()) if last else stop
        yield from RUN.findall(text, at, stop)
        at = stop


def misspelt(doc_id: int | None, run: str, every: int) -> str:
    """The run without one code point if crc32 of `doc_id:run` is divisible by `every`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(doc_id: int | None, text: str, every: int) -> Counter:
    """Counts of a document's words, before any is left out."""
    lowered, out = Counter(), Counter()
    for run, n in Counter(runs(text)).items():
        lowered[lower(run)] += n
    for run, n in lowered.items():
        out[misspelt(doc_id, run, every)] += n
    return out


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least `length` code points that stand at least `least` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("spelling")
        held = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py() or "", every).items():
                    if len(word) >= length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    found = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of code points."""
    powers = _powers(codes.shape[1])
    return (LETTER[codes] * powers[-2::-1]).sum(1, dtype=np.uint64)


def places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where one of its probes looks for a hash in a filter of 2^bits bits."""
    x = h ^ (h >> np.uint64(33))
    x = x * MIX[probe]
    return (x ^ (x >> np.uint64(29))) * BASE >> np.uint64(64 - bits)


def passing(h: np.ndarray, filter_: np.ndarray, bits: int) -> np.ndarray:
    """Indices into h, flat, of what the filter may hold."""
    at = np.arange(h.size)
    h = h.ravel()
    for probe in range(PROBES):
        p = places(h[at], probe, bits)
        at = at[(filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def neighbourhood(words: np.ndarray, alphabet: np.ndarray, keep) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row, string): distinct deletions, replacements and insertions of words of one length, rows of code points, whose hashes `keep` (hashes to indices) passes."""
    m, n = words.shape
    powers, letters = _powers(n + 1), LETTER[words]
    part = letters * powers[n - 1 :: -1][:n] if n else letters  # what each letter gives to the hash
    whole = part.sum(1, dtype=np.uint64)
    before = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(part, 1, dtype=np.uint64)), 1)
    after = whole[:, None] - before  # of the letters from i on
    # Of the letters before i, with one letter fewer or more behind them.
    shorter = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(letters[:, : n - 1] * powers[n - 2 :: -1][: n - 1], 1, dtype=np.uint64)), 1) if n > 1 else np.zeros((m, 1), np.uint64)
    longer = before * BASE
    text = [bytes(w.astype(np.uint8)).decode("latin-1") for w in words]
    new = [chr(a) for a in alphabet]

    deleted = shorter[:, :n] + after[:, 1:]
    first = np.ones((m, n), bool)
    first[:, 1:] = words[:, 1:] != words[:, :-1]
    at = keep(deleted)
    at = at[first.ravel()[at]]
    row, i = np.divmod(at, n)
    yield row, [text[r][:k] + text[r][k + 1 :] for r, k in zip(row.tolist(), i.tolist())]

    step = powers[n - 1 :: -1][:n]
    replaced = (whole[:, None] - part)[:, :, None] + step[None, :, None] * LETTER[alphabet]
    at = keep(replaced)
    row, i, a = np.unravel_index(at, replaced.shape)
    other = words[row, i] != alphabet[a]
    row, i, a = row[other], i[other], a[other]
    yield row, [text[r][:k] + new[x] + text[r][k + 1 :] for r, k, x in zip(row.tolist(), i.tolist(), a.tolist())]

    inserted = (longer + after)[:, :, None] + powers[n::-1][: n + 1][None, :, None] * LETTER[alphabet]
    at = keep(inserted)
    row, i, a = np.unravel_index(at, inserted.shape)
    last = np.concatenate((words, np.full((m, 1), -1)), 1)[row, i] != alphabet[a]
    row, i, a = row[last], i[last], a[last]
    yield row, [text[r][:k] + new[x] + text[r][k:] for r, k, x in zip(row.tolist(), i.tolist(), a.tolist())]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, np.frombuffer("".join(words[r] for r in rows).encode("latin-1"), np.uint8).reshape(len(rows), n).astype(np.int64)


def bloom(words: DataFrame, bits: int) -> bytes:
    """The vocabulary's filter: each task's bits, put together by segments of 64 KB in Spark."""
    segment = 1 << 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, codes in by_length(batch.column("word").to_pylist()):
                h = hashes(codes)
                found += [places(h, probe, bits) for probe in range(PROBES)]
            p = np.unique(np.concatenate(found)).astype(np.int64)
            at, which = np.unique(p >> 6, return_inverse=True)
            bit = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bit, which, np.uint64(1) << (p & 63).astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "bits": pa.array(bit.view(np.int64))})

    words64 = words.select("word").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, np.zeros(segment // 8, np.int64)
        row = lambda: pa.RecordBatch.from_pydict({"s": pa.array([here], pa.int64()), "b": pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())})
        for batch in batches:
            at, bit = batch.column("at").to_numpy(), batch.column("bits").to_numpy()
            for s in np.unique(at // len(held)):
                if s != here:
                    if here is not None:
                        yield row()
                    here, held = int(s), np.zeros_like(held)
                mine = at // len(held) == s
                held[at[mine] % len(held)] |= bit[mine]
        if here is not None:
            yield row()

    parts = words64.withColumn("s", F.floor(F.col("at") / (segment // 8))).repartition("s").sortWithinPartitions("s").select("at", "bits").mapInArrow(pack, "s long, b binary")
    out = bytearray(max(1 << (bits - 3), segment))
    for r in parts.collect():  # 64 MB at most
        out[r["s"] * segment : (r["s"] + 1) * segment] = zlib.decompress(r["b"])
    return bytes(out)


def near_words(words: DataFrame, spread: int = 4) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words(word, n) that differ by exactly one inserted, deleted or replaced code point."""
    spark = words.sparkSession
    size = words.count()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, size * BITS_A_WORD))))))
    held = spark.sparkContext.broadcast(bloom(words, bits))
    alphabet = sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())  # of at most 90

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("spelling")
        filter_, letters = np.frombuffer(held.value, np.uint8), np.array(alphabet, np.int64)
        keep = lambda h: passing(h, filter_, bits)
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            for rows, codes in by_length(words.to_pylist()):
                step = max(1, AT_ONCE * 8 // (codes.shape[1] + 1))
                for s in range(0, len(rows), step):
                    for row, near in neighbourhood(codes[s : s + step], letters, keep):
                        at = pa.array(rows[s + row])
                        yield pa.RecordBatch.from_arrays([words.take(at), n.take(at), pa.array(near, pa.string())], ["word", "n", "near"])

    tasks = spread * spark.sparkContext.defaultParallelism
    made = words.repartition(max(tasks, common.parts_for(words)), "word").mapInArrow(emit, "word string, n long, near string")
    return made.join(words.select(F.col("word").alias("w"), F.col("n").alias("near_n")), F.col("near") == F.col("w")).drop("w")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms(word, form) that starts at each word with a form.

    Pointers double: after i steps a word points 2^i forms ahead, so the steps are the
    logarithm of the longest chain, which is at most the logarithm of the largest count.
    """
    to = common.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = to.select(F.col("word").alias("w"), F.col("root").alias("next"))
        met = common.written(to.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "spelling-roots")
        common.dropped(to)
        to = met.select("word", "root")
        to.stored_at = met.stored_at
        if met.where("went").isEmpty():
            return to


def variants(docs: DataFrame, length: int = 5, least: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: the vocabulary, each word with its most frequent neighbour if that stands at least `times` as often.

    Ties between neighbours go to the smallest in code-point order; the root is where the
    forms of forms end, the word itself where it has none. Null and empty texts have no
    word, repeated rows count each, a null doc_id reads as empty. Words longer than others
    have no other bound than their text. Other columns are not read. An empty table gives
    no row.
    """
    words = common.written(vocabulary(docs.select(F.col("doc_id").cast("long"), "text"), length, least, every), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    held = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    strong = F.coalesce(-F.col("best.m") >= F.lit(times) * F.col("n"), F.lit(False))
    held = common.written(held.select("word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.m")).alias("form_n")), "spelling-forms")
    roots = _roots(held.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return held.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
