"""Exact top-k by inner product over integer vectors, by elimination with a pivot table.

A bounded sample gives PIVOTS pivots far from each other; every vector's distances to all
of them are computed once and stored. By the triangle inequality the largest difference
between two vectors' entries bounds their distance from below, hence their inner product
(|q|^2 + |c|^2 - distance^2) / 2 from above. Vectors are range-sorted by their nearest
pivot and the distance to it and cut into chunks of CHUNK rows, each with the box of its
entries:

1. Each query searches the chunk it lies in, which gives a floor for its k-th score.
2. Queries meet the chunks' boxes, in blocks of BOXES; what a box bounds below the floor
   is left out as a whole.
3. Rows and the queries that are left meet by (block of queries, chunk), an equi-join.
   A query evaluates a chunk's rows in the order of their bounds and stops where the next
   bound lies below its k-th best score, or its floor.

Bounds have a margin for their rounding, scores are exact integers: no step loses a row,
and pivots only decide how much is left out. Equal vectors are searched once, with the
k + 1 smallest ids of each; no more of them can be among k others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIVOTS, CHUNK, BOXES = 32, 2048, 4096
#: Rows of consecutive chunks whose queries travel together.
SPAN = 64 * CHUNK
#: Rows, and bytes, of the sample from which pivots are chosen.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
ASKED_AT_ONCE, FIRST_LOOK = 128, 128
#: Relative error that stored distances may have.
MARGIN = 1e-6


def far_apart(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """At most `most` different rows: the first, then always the one farthest from those chosen."""
    x = sample.astype("<f8")
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot, as they are stored."""
    x, p = v.astype("<f8"), pivots.astype("<f8")
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T))).astype("<f4")


class Space:
    """Vectors of one length with their scores and bounds; `most` is the largest component in size."""

    def __init__(self, width: int, most: int, pivots: np.ndarray):
        self.width, self.pivots = width, pivots
        self.plain = width * most * most < 1 << 53
        self.slack = 2.0 * MARGIN * float(np.sqrt((pivots.astype("<f8") ** 2).sum(1).max(initial=0)))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond a double's integers in Python's, an error beyond 64 bits."""
        if self.plain:
            return (rows @ q).astype(np.int64)
        out = rows.astype(object) @ q.astype(object)
        return np.array([self.long(x) for x in out], np.int64)

    @staticmethod
    def long(x: int) -> int:
        if not -(1 << 63) <= x < 1 << 63:
            raise ValueError(f"a score of {x} does not fit in 64 bits")
        return int(x)

    def bounds(self, q_norms, q_far, norms, far) -> np.ndarray:
        """Upper bounds of the inner products of queries and rows; far: distances to pivots, by row."""
        gap = np.zeros((len(q_far), len(far)), "<f4")
        for a, b in zip(q_far.T, far.T):
            np.maximum(gap, np.abs(a[:, None] - b), out=gap)
        return self._upper(q_norms, norms, gap)

    def box_bounds(self, q_norms, q_far, most_norms, least, most) -> np.ndarray:
        """The same for boxes of distances, whose rows have at most the given squared lengths."""
        gap = np.zeros((len(q_far), len(least)), "<f4")
        for a, lo, hi in zip(q_far.T, least.T, most.T):
            np.maximum(gap, np.maximum(a[:, None] - hi, lo - a[:, None]), out=gap)
        return self._upper(q_norms, most_norms, gap)

    def _upper(self, q_norms, norms, gap) -> np.ndarray:
        both = q_norms[:, None] + norms
        sure = np.maximum(0, gap - (self.slack + MARGIN * (np.sqrt(q_norms)[:, None] + np.sqrt(norms))))
        return (both - sure * sure) * 0.5 + 1e-12 * both


def in_bound_order(space: Space, rows: np.ndarray, first: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows that reach the floor, ties to the smaller first id, and how many were evaluated; the highest bounds come first."""
    left = np.flatnonzero(bound >= floor)
    left = left[np.argsort(-bound[left], kind="stable")]
    at, scores, seen, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_LOOK
    while seen < len(left) and bound[left[seen]] >= floor:
        look = left[seen : seen + step]
        at, scores = np.concatenate((at, look)), np.concatenate((scores, space.scores(rows[look], q)))
        if len(at) > k:
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            keep = keep[np.lexsort((first[at[keep]], -scores[keep]))][:k]
            at, scores = at[keep], scores[keep]
        if len(at) >= k:
            floor = max(floor, float(scores.min()))
        seen, step = seen + len(look), step * 2
    if floor > -np.inf:
        at, scores = at[scores >= floor], scores[scores >= floor]
    return at, scores, seen


def _ints(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _found(finds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(q, c, first, score) of each query's finds."""
    join = lambda k: np.concatenate([f[k] for f in finds]) if finds else np.zeros(0, np.int64)
    q = np.repeat(np.array([f[0] for f in finds], np.int64), [len(f[1]) for f in finds])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(join(1)), pa.array(join(2)), pa.array(join(3))], ["q", "c", "first", "score"])


class _Chunk:
    """Rows of a chunk as they come in, then as arrays."""

    def __init__(self):
        self.at, self.first, self.norm, self.v, self.far = [], [], [], [], []

    def add(self, at, first, norm, v, far):
        self.at.append(at), self.first.append(first), self.norm.append(norm), self.v.append(v), self.far.append(far)

    def close(self, space: Space, kind: str) -> _Chunk:
        n = len(self.at)
        self.at, self.first, self.norm = np.array(self.at, np.int64), np.array(self.first, np.int64), np.array(self.norm, "<f8")
        self.v = np.frombuffer(b"".join(self.v), kind).reshape(n, space.width)
        self.v = self.v.astype("<f8") if space.plain else self.v
        self.far = np.frombuffer(b"".join(self.far), "<f4").reshape(n, len(space.pivots))
        return self

    def search(self, space: Space, asks: _Chunk, floors: np.ndarray, k: int) -> list[tuple]:
        out = []
        for s in range(0, len(asks.at), ASKED_AT_ONCE):
            mine = slice(s, s + ASKED_AT_ONCE)
            bounds = space.bounds(asks.norm[mine], asks.far[mine], self.norm, self.far)
            for q, v, bound, floor in zip(asks.at[mine], asks.v[mine], bounds, floors[mine]):
                at, scores, _ = in_bound_order(space, self.v, self.first, v, bound, k, floor)
                out.append((q, self.at[at], self.first[at], scores))
        return out


ROW = ("at", "first", "norm", "v", "far")


def _line(base: DataFrame, space: Space, kind: str) -> DataFrame:
    """(at, chunk, first, ids, asks, norm, v, far): base(v, ids, asks) numbered along the pivots, written."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _ints(batch.column("v"), kind, space.width)
            far = distances(v, space.pivots)
            home, x = far.argmin(1), v.astype("<f8")
            columns = {"home": pa.array(home, pa.int32()), "away": pa.array(far[np.arange(len(v)), home]), "v": batch.column("v"), "ids": batch.column("ids"), "asks": batch.column("asks"), "norm": pa.array((x * x).sum(1)), "far": pa.array([f.tobytes() for f in far], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    kept = "v binary, ids array<long>, asks boolean, norm double, far binary"
    line = base.mapInArrow(keyed, f"home int, away float, {kept}")
    line = line.repartitionByRange(common.parts_for(base), "home", "away", "v").sortWithinPartitions("home", "away", "v")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part), pa.int32()), "place": pa.array(np.arange(seen, seen + n))} | {c: batch.column(c) for c in ("v", "ids", "asks", "norm", "far")})
            seen += n

    line = common.written(line.mapInArrow(numbered, f"part int, place long, {kept}"), "pivot-line")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    first = line.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("place")
    return line.join(F.broadcast(first), "part").select(at.alias("at"), F.floor(at / CHUNK).alias("chunk"), F.col("ids")[0].alias("first"), "ids", "asks", "norm", "v", "far")


def _seeded(line: DataFrame, space: Space, kind: str, k: int) -> DataFrame:
    """Each chunk's finds for its own queries (q, c, first, score, floor), and its box (chunk, most, box), the rest null; written."""
    schema = "chunk long, most double, box binary, q long, c long, first long, score long, floor double"

    def out(**columns) -> pa.RecordBatch:
        kinds = {"chunk": pa.int64(), "most": pa.float64(), "box": pa.binary(), "q": pa.int64(), "c": pa.int64(), "first": pa.int64(), "score": pa.int64(), "floor": pa.float64()}
        n = len(next(iter(columns.values())))
        held = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in columns.items()}
        return pa.RecordBatch.from_pydict({c: held.get(c, pa.nulls(n, t)) for c, t in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chunk, asked = None, _Chunk(), []

        def close() -> Iterator[pa.RecordBatch]:
            rows, asks = chunk.close(space, kind), _Chunk()
            yield out(chunk=[int(here)], most=[rows.norm.max()], box=[np.concatenate((rows.far.min(0), rows.far.max(0))).tobytes()])
            own = np.array(asked, np.int64)
            asks.at, asks.v, asks.far, asks.norm = rows.at[own], rows.v[own], rows.far[own], rows.norm[own]
            if len(own):
                finds = rows.search(space, asks, np.full(len(own), -np.inf), k)
                floors = np.repeat([float(f[3].min()) if len(f[3]) == k else -np.inf for f in finds], [len(f[3]) for f in finds])
                yield out(**{c: _found(finds).column(c) for c in ("q", "c", "first", "score")}, floor=floors)

        for batch in batches:
            for number, asks, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "asks", *ROW))):
                if number != here:
                    if here is not None:
                        yield from close()
                    here, chunk, asked = number, _Chunk(), []
                if asks:
                    asked.append(len(chunk.at))
                chunk.add(*row)
        if here is not None:
            yield from close()

    rows = line.select("chunk", "asks", *ROW).repartition(common.parts_for(line), "chunk").sortWithinPartitions("chunk", "at")
    return common.written(rows.mapInArrow(run, schema), "pivot-seeds", line)


def _asking(queries: DataFrame, boxes: DataFrame, space: Space) -> DataFrame:
    """queries with each chunk other than their own whose box reaches their floor, as column `chunk`; written.

    Boxes go in blocks of BOXES; a query meets every block, in tasks by block and span.
    """
    blocks = -(-boxes.count() // BOXES)
    block = boxes.select(F.floor(F.col("chunk") / BOXES).cast("int").alias("block"), F.col("chunk").alias("box_of"), "most", "box")
    spans = queries.select("span").distinct()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = block.join(spans.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block").select("block", "span", "box_of", "most", "box", *(none(c, dict(queries.dtypes)[c]) for c in ("own", *ROW, "floor")))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "span", none("box_of", "long"), none("most", "double"), none("box", "binary"), "own", *ROW, "floor")
    both = left.union(right).repartition(common.parts_for(queries), "block", "span").sortWithinPartitions("block", "span", F.col("box_of").asc_nulls_last(), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, boxed = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("span").to_pylist()))
            is_box = np.asarray(batch.column("box_of").is_valid())
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or is_box[i] != is_box[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if keys[a] != here:
                    here, held, boxed = keys[a], [], None
                if is_box[a]:
                    held += zip(*(part.column(c).to_pylist() for c in ("box_of", "most", "box")))
                    continue
                if boxed is None:
                    box = np.frombuffer(b"".join(h[2] for h in held), "<f4").reshape(len(held), 2, len(space.pivots))
                    boxed = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held]), box[:, 0], box[:, 1]
                for s in range(0, len(part), ASKED_AT_ONCE):
                    some = part.slice(s, ASKED_AT_ONCE)
                    far = np.frombuffer(b"".join(some.column("far").to_pylist()), "<f4").reshape(len(some), len(space.pivots))
                    reach = space.box_bounds(some.column("norm").to_numpy(), far, *boxed[1:]) >= some.column("floor").to_numpy()[:, None]
                    q, c = np.nonzero(reach & (boxed[0] != some.column("own").to_numpy()[:, None]))
                    for t in range(0, len(q), BOXES):
                        at = pa.array(q[t : t + BOXES])
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array(boxed[0][c[t : t + BOXES]])} | {name: some.column(name).take(at) for name in ("span", *ROW, "floor")})

    return common.written(both.mapInArrow(run, "chunk long, span long, at long, first long, norm double, v binary, far binary, floor double"), "pivot-asking")


def _searched(line: DataFrame, asking: DataFrame, space: Space, kind: str, k: int) -> DataFrame:
    """(q, c, first, score): for each row of asking the best rows of its chunk that reach its floor."""
    pairs = asking.select("span", "chunk").distinct()
    rows = line.join(pairs, "chunk").select("span", "chunk", F.lit(None).cast("double").alias("floor"), *ROW)
    both = rows.union(asking.select("span", "chunk", "floor", *ROW)).repartition(common.parts_for(line), "span", "chunk").sortWithinPartitions("span", "chunk", F.col("floor").asc_nulls_first(), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, open_, asks, floors = None, _Chunk(), True, _Chunk(), []

        def answer() -> pa.RecordBatch:
            nonlocal asks, floors, open_
            if open_:
                rows.close(space, kind)
                open_ = False
            found = rows.search(space, asks.close(space, kind), np.array(floors), k)
            asks, floors = _Chunk(), []
            return _found(found)

        for batch in batches:
            for span, number, floor, *row in zip(*(batch.column(c).to_pylist() for c in ("span", "chunk", "floor", *ROW))):
                if (span, number) != here:
                    if floors:
                        yield answer()
                    here, rows, open_ = (span, number), _Chunk(), True
                if floor is None:
                    rows.add(*row)
                else:
                    asks.add(*row)
                    floors.append(floor)
                if len(floors) == ASKED_AT_ONCE:
                    yield answer()
        if floors:
            yield answer()

    return both.mapInArrow(run, "q long, c long, first long, score long")


def _of_width(rows: DataFrame, width: int, most: int, k: int, every: int, scale: int) -> DataFrame:
    """The result for vectors of one length."""
    kind = next(f"<i{b}" for b in (2, 4, 8) if b == 8 or most < 1 << (8 * b - 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("e").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(batch), width)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": pa.array([x.tobytes() for x in np.floor(v * scale).astype(kind)], pa.binary())})

    rows = common.written(rows.where(F.size("e") == width).mapInArrow(packed, "vec_id long, v binary"), "pivot-rows")
    asked = rows.where(F.col("vec_id") % every == 0)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    few = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = asked.select(F.col("v").alias("w")).distinct()
    base = common.written(few.join(wanted, F.col("v") == F.col("w"), "left").select("v", "ids", F.col("w").isNotNull().alias("asks")), "pivot-base", rows)
    sample = base.orderBy(F.xxhash64("v"), "v").limit(max(PIVOTS, min(SAMPLE, SAMPLE_BYTES // (8 * width + 1)))).select("v").collect()
    space = Space(width, most, far_apart(np.frombuffer(b"".join(r["v"] for r in sample), kind).reshape(len(sample), width)))
    line = _line(base, space, kind)
    seeds = _seeded(line, space, kind, k + 1)
    floors = seeds.where("q IS NOT NULL").groupBy("q").agg(F.max("floor").alias("floor"))
    queries = line.where("asks").join(floors, F.col("at") == F.col("q")).select(F.floor(F.col("at") / SPAN).alias("span"), F.col("chunk").alias("own"), *ROW, "floor")
    asking = _asking(common.written(queries, "pivot-queries", line), seeds.where("q IS NULL").select("chunk", "most", "box"), space)
    finds = seeds.where("q IS NOT NULL").select("q", "c", "first", "score").union(_searched(line, asking, space, kind, k + 1))
    top = finds.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 1)
    hits = top.join(line.select(F.col("at").alias("c2"), "ids"), F.col("c") == F.col("c2")).select("q", F.explode("ids").alias("id"), "score")
    hits = hits.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1).alias("best"))  # at most k + 1 ids of k + 1 vectors
    own = _lengths(line.where("asks").select("at", "v"), space, kind).join(hits, F.col("at") == F.col("q")).select(F.col("v").alias("w"), "own", "best")
    given = asked.join(own, F.col("v") == F.col("w"))
    # A query's own row goes once; where it isn't among the best, the last of them goes.
    mine = F.array_position("best", F.struct((-F.col("own")).alias("s"), F.col("vec_id").alias("id")))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("mine")), 1, k)
    ranked = given.withColumn("mine", mine).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _lengths(rows: DataFrame, space: Space, kind: str) -> DataFrame:
    """rows(at, v) with each vector's exact inner product with itself, as `own`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _ints(batch.column("v"), kind, space.width)
            own = (v.astype("<i8") ** 2).sum(1) if space.plain else [space.long(sum(int(x) * int(x) for x in row)) for row in v]
            yield pa.RecordBatch.from_pydict({"at": batch.column("at"), "v": batch.column("v"), "own": pa.array(own, pa.int64())})

    return rows.mapInArrow(run, "at long, v binary, own long")


def exact_top(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of integer vectors floor(scale * x), for each row whose vec_id is divisible by `every`.

    Every other row of the query's length is a candidate, also one of the same vec_id or
    the same vector; with fewer than k all are given. Ties go to the smaller vec_id, and a
    repeated row is a query, and a candidate, as often as it stands. Vectors that are null
    or hold null or non-finite components take no part, nor do rows of null vec_id; zero
    vectors do. Components or scores beyond 64 bits are an error. Other columns are not
    read. An empty table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & common.finite(F.col("e")))
    largest = F.coalesce(F.array_max(F.transform("e", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    parts = []
    for width, most in sorted(rows.groupBy(F.size("e").alias("w")).agg(F.max(largest).alias("most")).collect()):  # a row a length
        if most * scale >= 1 << 62:
            raise ValueError(f"components of {most} do not fit in 64 bits")
        parts.append(_of_width(rows, width, int(most * scale) + 1, k, every, scale))
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for p in parts[1:]:
        out = out.union(p)
    return out
