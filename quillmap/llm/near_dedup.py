"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of every shingle, exact. Documents go to blocks by a hash; a block
   sends its different shingles, with the number of its documents that hold each, to the
   ranges of hashes that they belong to. A range adds up what it was sent and answers
   each block in the order of its question; blocks that hold no recurring shingle get no
   answer. So no table of shingles is collected or broadcast. A large group of near copies
   raises the counts of what its members share, though they should still meet; so idf is
   added to its greatest value: tf (1 + idf / max idf) / 2, idf = ln(1 + N / df).
2. Improved consistent weighted sampling: with r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a
   hash of shingle and sample, t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the
   shingle of least a, with its t, is the sample. Two texts share one with the
   probability of their weighted Jaccard similarity.
3. Bands of samples are bucket keys. Exact copies count once there. Buckets with the
   same members are verified once. A bucket is verified by links to its first members,
   each text against every member that isn't yet in its class; larger buckets in chunks,
   whose class heads then meet in the same way, so that no task holds a whole bucket. In
   the end every member outside such a bucket's largest class meets every other member,
   block by block, so chunks lose no link.
4. Linked texts form classes by contraction: every text hooks onto its smallest smaller
   neighbour, chains are flattened, and links are carried over to what remains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: Bytes of text of a block and of a range of hashes; a small table has 256 blocks.
BLOCK, RANGE = 8 << 20, 8 << 20
BANDS, ROWS = 12, 4
#: Texts of a chunk, and shingles that count as one more text, so that a chunk of long texts holds fewer.
CHUNK, LONG = 256, 8192
#: Words of 64 bits of the filter of wanted texts: a quarter of the texts' number, within these powers of two.
LEAST_WORDS, MOST_WORDS = 17, 20
_tables: list[tuple[np.ndarray, ...]] = []


def samplers() -> tuple[np.ndarray, ...]:
    """Multipliers by sample, and r, 1 / r and ln c by 16 bits of hash, as quantiles of Gamma(2, 1)."""
    if not _tables:
        p = (np.arange(65536) + 0.5) / 65536
        x = np.full(65536, 1.5)
        for _ in range(60):
            x = np.maximum(1e-4, x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(1e-12, x * np.exp(-x)) * 0.8)
        r = x.astype(np.float32)
        odd = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _tables.append((odd, r, (1 / r).astype(np.float32), np.log(r)))
    return _tables[0]


class Weights:
    """Shingle -> (1 + idf / max idf) / 2 with idf = ln(1 + N / df), from the recurring shingles here or counts that come with a text; others are in one document."""

    def __init__(self, n_docs: int, grams: np.ndarray = np.zeros(0, np.uint64), df: np.ndarray = np.zeros(0, np.uint32)):
        order = np.argsort(grams)
        self.n_docs, self.grams, self.df = max(1, n_docs), grams[order], df[order]

    def of(self, text: str, df: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a text, ascending, and their weights tf * idf."""
        grams, tf = np.unique(shingles.of(text), return_counts=True)
        return grams, self.weigh(tf, _unpacked(df) if df else self.counts(grams))

    def counts(self, grams: np.ndarray) -> np.ndarray:
        df = np.ones(len(grams), np.uint32)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            known = self.grams[at] == grams
            df[known] = self.df[at[known]]
        return df

    def weigh(self, tf: np.ndarray, df: np.ndarray) -> np.ndarray:
        return tf.astype(np.float32) * (0.5 + 0.5 * np.log1p(self.n_docs / df) / np.log1p(self.n_docs)).astype(np.float32)


def _dense(grams: np.ndarray) -> bytes:
    """Ascending shingles as their differences, by planes of bytes, of which the upper ones hold little."""
    steps = np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def _shingles(dense: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(dense), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint32).tobytes())


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)


def signature(grams: np.ndarray, weights: np.ndarray, block: int = 2048) -> np.ndarray:
    """One key a band, as 64-bit integers."""
    odd, r_of, inverse_of, lnc_of = samplers()
    best = np.full(len(odd), np.inf, np.float32)
    found = np.zeros(len(odd), np.uint64)
    rows = np.arange(len(odd))
    lnw = np.log(weights)
    for a in range(0, len(grams), block):
        g, w = grams[a : a + block], lnw[a : a + block]
        u = g[None, :] * odd[:, None]
        u ^= u >> np.uint64(32)
        u *= np.uint64(0x9E3779B97F4A7C15)
        bits = u.view(np.uint16).reshape(len(odd), len(g), 4)
        i = bits[:, :, 3]
        r = r_of.take(i)
        b = bits[:, :, 1].astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(inverse_of.take(i) * w + b)
        lna = lnc_of.take(bits[:, :, 2]) - r * (t - b + np.float32(1))
        at = lna.argmin(1)
        low = lna[rows, at]
        less = low < best
        best[less] = low[less]
        found[less] = (g[at] * np.uint64(31) + t[rows, at].astype(np.int64).view(np.uint64))[less]
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        keys = shingles.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + found[k::ROWS])
    return keys.view(np.int64)


def blocked(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs(doc_id, text) with the block that each row goes to, their number, and the bits of a hash that name its range."""
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = -(-size // min(BLOCK, max(1 << 16, size >> 8))) + 1
    bits = min(16, max(4, (size // RANGE).bit_length()))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), n_docs, bits


def _edges(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of hashes starts among ascending shingles, and where the last one ends."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(grams, starts), len(grams))


def asked(rows: DataFrame, bits: int, tasks: int) -> DataFrame:
    """(block, part, grams, n): the different shingles of a block in a range of hashes, ascending, and how many of its documents hold each."""

    def sent(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        ends = _edges(grams, bits)
        parts = [p for p in range(1 << bits) if ends[p] < ends[p + 1]]
        cut = lambda x, p: x[ends[p] : ends[p + 1]]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array([_dense(cut(grams, p)) for p in parts], pa.binary()), pa.array([_packed(cut(n, p)) for p in parts], pa.binary())], ["block", "part", "grams", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("near_dedup")
        at, held = None, []
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), common.texts(batch)):
                if block != at and held:
                    yield sent(at, held)
                    held = []
                at = block
                held.append(np.unique(shingles.of(text)))
        if held:
            yield sent(at, held)

    return rows.select("block", "text").repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, "block long, part int, grams binary, n binary")


def _by_range(questions: DataFrame, tasks: int, told, schema: str) -> DataFrame:
    """What `told` makes of each range: its number, its questions' blocks and shingles, and the document frequency of each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("near_dedup")
        at, held = None, []

        def done() -> pa.RecordBatch:
            grams = [_shingles(g) for _, g, _ in held]
            _, where = np.unique(np.concatenate(grams), return_inverse=True)
            df = np.bincount(where, np.concatenate([_unpacked(n) for _, _, n in held])).astype(np.uint32)[where]
            return told(at, [b for b, _, _ in held], grams, df)

        for batch in batches:
            for part, *question in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "grams", "n"))):
                if part != at and held:
                    yield done()
                    held = []
                at = part
                held.append(question)
        if held:
            yield done()

    return questions.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def answers(questions: DataFrame, tasks: int) -> DataFrame:
    """(block, part, df): the document frequencies of a question's shingles, in its order; none where all are 1."""

    def told(part: int, blocks: list[int], grams: list[np.ndarray], df: np.ndarray) -> pa.RecordBatch:
        cuts = np.split(df, np.cumsum([len(g) for g in grams])[:-1])
        out = [(b, _packed(x)) for b, x in zip(blocks, cuts) if x.max() > 1]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "part", "df"])

    return _by_range(questions, tasks, told, "block long, part int, df binary")


def frequencies(docs: DataFrame) -> Weights:
    """Weights from the exact document frequencies of all shingles of docs(text), collected: for tables whose recurring shingles fit a process. `near_classes` leaves them on the executors."""
    rows, n_docs, bits = blocked(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    tasks = common.parts_for(docs)

    def told(part: int, blocks: list[int], grams: list[np.ndarray], df: np.ndarray) -> pa.RecordBatch:
        found, first = np.unique(np.concatenate(grams), return_index=True)
        more = df[first] > 1
        return pa.RecordBatch.from_pydict({"gram": pa.array(found[more].view(np.int64)), "df": pa.array(df[first][more].astype(np.int64))})

    exact = _by_range(asked(rows, bits, tasks), tasks, told, "gram long, df long").toPandas()
    return Weights(n_docs, exact.gram.to_numpy(np.int64).view(np.uint64), exact.df.to_numpy(np.int64).astype(np.uint32))


def signed(rows: DataFrame, found: DataFrame, shared, bits: int, tasks: int) -> DataFrame:
    """`signatures` of rows(doc_id, text, block) by the answers to their blocks, with df: the frequencies of a text's different shingles, ascending, packed; empty if all are 1."""
    told = found.select("block", "part", "df", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    told = told.unionByName(rows.select("block", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("df"), "doc_id", "text"))

    def done(idents: list, texts: list[str], parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sets = [np.unique(shingles.of(t), return_counts=True) for t in texts]
        every = np.unique(np.concatenate([g for g, _ in sets]))
        df, ends = np.ones(len(every), np.uint32), _edges(every, bits)
        for part, counts in parts:
            df[ends[part] : ends[part + 1]] = _unpacked(counts)
        bands, packed = [], []
        for grams, tf in sets:
            own = df[np.searchsorted(every, grams)]
            bands.append(signature(grams, shared.value.weigh(tf, own)) if len(grams) else [])
            packed.append(_packed(own) if len(own) and own.max() > 1 else b"")
        copies = [_copy(t) for t in texts]
        sizes = [len(g) for g, _ in sets]
        return pa.RecordBatch.from_arrays([pa.array(idents, pa.int64()), pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "copy", "bands", "size", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("near_dedup")
        at, idents, texts, parts = None, [], [], []
        for batch in batches:
            for block, part, df, ident, text in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "df", "doc_id", "text"))):
                if block != at and texts:
                    yield done(idents, texts, parts)
                    idents, texts, parts = [], [], []
                at = block
                if part is not None:
                    parts.append((part, df))
                else:
                    idents.append(ident)
                    texts.append(text or "")
        if texts:
            yield done(idents, texts, parts)

    dealt = told.repartition(tasks, "block").sortWithinPartitions("block", F.col("part").asc_nulls_last())
    return dealt.mapInArrow(run, "doc_id long, copy binary, bands array<long>, size long, df binary")


def signatures(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, copy, bands, size): copy is a 128-bit hash of the words, bands are empty for texts without a word, size is the number of different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("near_dedup")
        for batch in batches:
            copies, bands, sizes = [], [], []
            for text in common.texts(batch):
                copies.append(_copy(text))
                grams, weights = shared.value.of(text)
                bands.append(signature(grams, weights) if len(grams) else [])
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "copy", "bands", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, copy binary, bands array<long>, size long")


def linked(reps: list[int], sets: list[tuple[np.ndarray, np.ndarray]], similar: float = shingles.SIMILAR) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join the classes of texts, given by their shingles and weights, and the first member of each class.

    Each text is compared with every later one that isn't in its class by then, so the
    classes are those of all pairs at the similarity or above.
    """
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    root = np.arange(len(reps))
    sizes = [len(g) for g, _ in sets]
    every_g, every_w = np.concatenate([g for g, _ in sets]), np.concatenate([w for _, w in sets])
    ends = np.cumsum(sizes)
    out = []
    for p in range(len(reps) - 1):
        later = np.arange(p + 1, len(reps))
        later = later[(root[later] != root[p]) & (total[later] * similar <= total[p] * 1.0001) & (total[p] * similar <= total[later] * 1.0001)]
        if not len(later):
            continue
        g, w = sets[p]
        if len(later) * 4 < len(reps) - p or len(later) < 8:
            minima = np.array([_minima(g, w, *sets[j]) for j in later])
        else:
            a = int(ends[p])
            at = np.minimum(np.searchsorted(g, every_g[a:]), len(g) - 1)
            same = np.where(g[at] == every_g[a:], np.minimum(w[at], every_w[a:]), 0).astype(np.float64)
            sums = np.concatenate(([0.0], np.cumsum(same)))
            minima = (sums[ends[later] - a] - sums[ends[later - 1] - a])
        for j in later[minima >= similar * (total[p] + total[later] - minima) - 1e-9]:
            if root[j] != root[p]:
                out.append((reps[p], reps[j]))
                root[root == root[j]] = root[p]
    return out, [reps[i] for i in np.unique(root, return_index=True)[1]]


def _minima(g: np.ndarray, w: np.ndarray, g2: np.ndarray, w2: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(g, g2), len(g) - 1)
    same = g[at] == g2
    return float(np.minimum(w[at[same]], w2[same]).sum(dtype=np.float64))


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id isn't in wanted(rep), by a Bloom filter of 16 bits a wanted text and 8 MB at most, so that few texts are shuffled."""
    words = 1 << min(MOST_WORDS, max(LEAST_WORDS, (wanted.count() // 4).bit_length()))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(1, {c}), 64) as int))")
    bits = wanted.groupBy(F.pmod(F.xxhash64("rep"), F.lit(words)).alias("word")).agg(F.bit_or(bit("rep")).alias("bits"))
    return docs.join(F.broadcast(bits), F.pmod(F.xxhash64("doc_id"), F.lit(words)) == F.col("word")).where(F.col("bits").bitwiseAND(bit("doc_id")) != 0).select("doc_id", "text")


def verify(members: DataFrame, docs: DataFrame, shared, known: DataFrame | None = None) -> DataFrame:
    """Links (kind 0: a, b) and class heads (kind 1: bucket, text) of buckets members(bucket, chunk, rep).

    Frequencies are those of known(doc_id, copy, df), a row for each text of an id; without it, those that `shared` holds.
    """
    wanted = common.written(members.select("rep").distinct(), "wanted", of=members)
    one = likely(docs, wanted).join(wanted, F.col("doc_id") == F.col("rep")).groupBy("rep").agg(F.min("text").alias("text"))
    if known is None:
        one = one.withColumn("dfs", F.lit(None).cast("array<struct<copy:binary,df:binary>>"))
    else:
        dfs = known.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.collect_list(F.struct("copy", "df")).alias("dfs"))
        one = one.join(dfs, "rep", "left")
    rows = members.join(one, "rep").select("bucket", "chunk", "rep", "text", "dfs")
    rows = rows.repartition(common.parts_for(docs), "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own("near_dedup")
        at, reps, held, found = None, [], [], []

        def done() -> None:
            if len(reps) > 1:
                pairs, heads = linked(reps, [shared.value.of(*x) for x in held])
                found.extend((0, a, b) for a, b in pairs)
            else:
                heads = reps
            found.extend((1, at[0], r) for r in heads)

        for batch in batches:
            for bucket, chunk, rep, text, dfs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "rep", "text", "dfs"))):
                if (bucket, chunk) != at:
                    if at is not None:
                        done()
                    at, reps, held = (bucket, chunk), [], []
                reps.append(rep)
                held.append((text or "", _own_df(text or "", dfs or [])))
            if found:
                yield _links(found)
                found = []
        if at is not None:
            done()
            yield _links(found)

    return rows.mapInArrow(run, "kind int, a long, b long")


def _own_df(text: str, dfs: list[dict]) -> bytes:
    """A text's frequencies, of those of all texts that share its id."""
    if len(dfs) == 1:
        return dfs[0]["df"]
    copy = _copy(text) if dfs else b""
    return next((x["df"] for x in dfs if x["copy"] == copy), b"")


def _copy(text: str) -> bytes:
    """A 128-bit hash of a text's words."""
    return xxhash.xxh3_128_digest(shingles.words_of(text).tobytes())


def _links(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["kind", "a", "b"])


def links(reps: DataFrame, docs: DataFrame, shared, chunk: int = CHUNK, known: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: links between different texts of weighted Jaccard similarity 0.8 or more that give the classes of reps(rep, bands, size); without sizes all texts count as short."""
    size = F.col("size") if "size" in reps.columns else F.lit(1).cast("long").alias("size")
    members = reps.select("rep", size, F.explode("bands").alias("bucket"))
    weigh = F.greatest(F.count("*"), F.ceil(F.sum("size") / LONG))
    groups = members.groupBy("bucket").agg(F.count("*").alias("k"), weigh.alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo")).where("k > 1")
    live = groups.groupBy("n", "x", "lo").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    start = at = common.written(members.join(live, "bucket"), "buckets", of=members)
    met, before = [], None
    for level in range(32):
        part = F.when(F.col("n") <= chunk, 0).otherwise(F.pmod(F.xxhash64("rep", "bucket", F.lit(level)), F.ceil(F.col("n") / chunk)))
        out = common.written(verify(at.select("bucket", "rep", part.alias("chunk")), docs, shared, known), "links", of=docs, tasks=4)
        met.append(out)
        over = at.where(F.col("n") > chunk).agg(F.count("*")).first()[0]
        if not over or before is not None and over > 0.8 * before:
            break
        heads = out.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("rep")).distinct().join(at.where(F.col("n") > chunk).select("bucket", "rep", "size"), ["bucket", "rep"])
        counts = heads.groupBy("bucket").agg(F.count("*").alias("k"), weigh.alias("n")).where("k > 1").drop("k")
        at, before = common.written(heads.join(counts, "bucket"), "buckets", of=at), over
    found = reduce(DataFrame.union, [x.where("kind = 0").select("a", "b") for x in met]).distinct()
    large = start.where(F.col("n") > chunk)
    if not large.limit(1).count():
        return found
    whole = common.written(found, "links", of=members)
    rest = common.written(stragglers(large, classes(whole), chunk), "stragglers", of=start, tasks=4)
    more = common.written(verify(rest, docs, shared, known), "links", of=docs, tasks=4)
    return whole.union(more.where("kind = 0").select("a", "b")).distinct()


def stragglers(large: DataFrame, comp: DataFrame, chunk: int) -> DataFrame:
    """(bucket, rep, chunk) that compares what chunks left apart: every member outside a bucket's largest class with every member.

    Such members go in blocks, and each block meets each chunk of its bucket. Within the
    largest class there is nothing left to link, so a bucket of copies costs little, and
    one of strangers all its comparisons, over as many tasks as it has pairs of blocks.
    """
    own = large.join(comp, large["rep"] == comp["v"], "left").select("bucket", "n", "rep", "size", F.coalesce("l", "rep").alias("l"))
    sizes = own.groupBy("bucket", "l").agg(F.count("*").alias("k"), F.sum("size").alias("long"))
    top = F.max_by(F.struct("l", "k", "long"), F.struct(F.col("k"), -F.col("l")))
    most = sizes.groupBy("bucket").agg(top.alias("t"), F.sum("k").alias("k"), F.sum("long").alias("long"))
    most = most.select("bucket", F.col("t.l").alias("top"), F.greatest(F.col("k") - F.col("t.k"), F.ceil((F.col("long") - F.col("t.long")) / LONG)).alias("minor"), (F.col("k") - F.col("t.k")).alias("others")).where("others > 0").drop("others")
    rows = own.join(most, "bucket")
    chunks, blocks = F.ceil(F.col("n") / chunk), F.ceil(F.col("minor") / chunk)
    c, b = F.pmod(F.xxhash64("rep", "bucket"), chunks), F.pmod(F.xxhash64("rep", "bucket", F.lit("block")), blocks)
    width = F.lit(1 << 31)
    every = rows.select("bucket", "rep", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: c * width + j)).alias("chunk"))
    minor = rows.where("l <> top").select("bucket", "rep", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda i: i * width + b)).alias("chunk"))
    return every.union(minor).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(v, l): the smallest node of the component of every node of edges(a, b).

    A node has at most as many links as the chunks that it was met in have members, times
    the bands and levels: a fixed number, however large its class.
    """
    left = common.written(edges, "edges", of=edges)
    nodes = left.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    comp = common.written(nodes.withColumn("l", F.col("v")), "classes", of=left)
    while left.limit(1).count():
        hook = common.written(left.groupBy(F.greatest("a", "b").alias("h")).agg(F.min(F.least("a", "b")).alias("p")), "hooks", of=left)
        while True:
            above = hook.select(F.col("h").alias("h2"), F.col("p").alias("p2"))
            flat = common.written(hook.join(above, hook["p"] == above["h2"], "left").select("h", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved")), "hooks", of=hook)
            common.dropped(hook)
            hook = flat
            if not flat.where("moved").limit(1).count():
                break
        flatter = common.written(comp.join(hook, comp["l"] == hook["h"], "left").select("v", F.coalesce("p", "l").alias("l")), "classes", of=comp)
        ha, hb = hook.select(F.col("h").alias("xa"), F.col("p").alias("pa")), hook.select(F.col("h").alias("xb"), F.col("p").alias("pb"))
        moved = left.join(ha, left["a"] == ha["xa"], "left").join(hb, F.col("b") == F.col("xb"), "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        fewer = common.written(moved.where("a <> b").distinct(), "edges", of=left)
        common.dropped(left, hook, comp)
        left, comp = fewer, flatter
    common.dropped(left)
    return comp


def _freed(df: DataFrame, name: str) -> DataFrame:
    """common.written, after which what was shuffled for it goes at once: these shuffles hold all texts and shingles."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return common.written(df, name)
    finally:
        conf.set(key, before)


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row of docs(doc_id, text); class_id is the smallest doc_id of its class.

    Texts whose words agree are copies. Texts without a word, null or empty, are a class
    each: their own. Texts under five words are one shingle. Rows that share a doc_id
    are told apart by their texts only while classes are formed; a doc_id met with
    several texts joins their classes by its smallest text. A null doc_id takes no part
    and gets a null class. Repeated rows stay. Other columns are not read. An empty
    table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, n_docs, bits = blocked(docs)
    tasks = common.parts_for(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Weights(n_docs))
    found = _freed(answers(asked(rows, bits, tasks), tasks), "frequencies")
    sig = _freed(signed(rows, found, shared, bits, tasks), "signatures")
    common.dropped(found)
    some = sig.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    reps = common.written(some.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size")), "copies", of=sig)
    known = sig.where("doc_id IS NOT NULL").groupBy("doc_id", "copy").agg(F.first("df").alias("df"))
    comp = classes(links(reps, docs, shared, known=known))
    heads = reps.join(comp, reps["rep"] == comp["v"], "left").select(F.col("copy").alias("c"), F.coalesce("l", "rep").alias("class_id"))
    return sig.select("doc_id", "copy", (F.size("bands") > 0).alias("some")).join(heads, (F.col("copy") == F.col("c")) & F.col("some") & F.col("doc_id").isNotNull(), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; all columns stay, whatever their names.

    A document is what shares a doc_id: its rows, repeated ones too, stay or go together.
    Rows of a null doc_id stay; so do texts without a word, null or empty, each on its own.
    """
    goes = common.free("drop", docs.columns)
    drop = near_classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(goes)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(goes), "left_anti")
