"""Approximate nearest neighbours along shifted Hilbert curves.

Largest inner product becomes nearest direction by one more component, sqrt(M^2 - |v|^2)
for rows and 0 for queries. Each of CURVES orderings projects the vectors onto DIMS
random directions, shifts the grid and numbers its cells along a Hilbert curve. Spark
range-partitions and sorts every ordering; runs of BLOCK rows make key windows, and a
query meets the rows of its own and of both neighbouring windows. Vectors travel along
the orderings as bytes, one a component and a scale; the orderings' best KEEP finds are
merged and reranked by the exact measure on the original vectors.

How often the farther half of the finds turned up over the orderings tells how many were
missed: if each ordering finds a neighbour with chance p, a find turns up in the share
p / (1 - (1 - p) ^ CURVES) of them and (1 - p) ^ CURVES of the neighbours are lost. Where
the mean over all queries stands for less than GOAL, queries below it ask again in
windows WIDER times as wide, until GOAL is met or the windows cover the curve.
Vectors without near neighbours in many dimensions have no locality that any curve could
keep, so their windows grow to a fixed share of the table.

Equal vectors are searched once, under a number of their own, with the k + 1 smallest
ids of each, and given those again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CURVES, DIMS, BITS = 8, 8, 7
BLOCK, WIDER = 2730, 4
#: Rows that one task holds; wider windows are several blocks of that many.
MOST_ROWS = 16_384
ASKED_AT_ONCE = 256
#: Finds of a query that are reranked, beyond those asked for, and the recall that the repeats of finds must stand for.
MORE, GOAL = 12, 0.92
REPEATED = (1 - (1 - GOAL) ** (1 / CURVES)) / GOAL


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells, by exchanging and inverting bits from the top."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of directions (rows of unit length, the added component last) in one ordering."""
    rng = np.random.default_rng(1000 + curve)
    width = vectors.shape[1]
    axes, _ = np.linalg.qr(rng.standard_normal((width, min(DIMS, width))))
    p = (vectors @ axes) * np.sqrt(width) / 8 + 0.5
    cells = np.clip(p, 0, 1) * 0.8 + rng.random(axes.shape[1]) * 0.2
    return hilbert(np.minimum((cells * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype("<f8")


def coded(vectors: np.ndarray) -> list[bytes]:
    """Each vector as its largest component (32 bits) and a byte a component in units of a 127th of it."""
    most = np.maximum(np.abs(vectors).max(1), 1e-300)
    bytes_of = np.rint(vectors / most[:, None] * 127).astype("i1")
    with np.errstate(over="ignore"):
        return [m.tobytes() + b.tobytes() for m, b in zip(np.minimum(most, np.finfo("f4").max).astype("<f4"), bytes_of)]


def decoded(codes: list[bytes], width: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(codes), np.dtype([("most", "<f4"), ("bytes", "i1", (width,))]))
    return rows["bytes"].astype("<f4") * (rows["most"] / np.float32(127))[:, None]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _found(q: list, c: list, s: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(q, np.int64)), pa.array(join(c, np.int64)), pa.array(join(s, np.float64))], ["q", "c", "score"])


def _placed(rows: DataFrame, queries: DataFrame, width: int, kind: str, most: float) -> DataFrame:
    """(curve, at, rep, asks, v): each ordering's rows(rep, v) numbered from 0, and queries(rep, v) at the number of the row before them; v coded."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width, kind)
            code = pa.array(coded(v), pa.binary())
            asks = np.array(batch.column("asks").to_pylist(), bool)
            norm = np.sqrt((v * v).sum(1))
            unit = np.hstack((v / np.where(asks, norm, most)[:, None], np.sqrt(np.maximum(0, 1 - np.where(asks, 1, (norm / most) ** 2)))[:, None]))
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), curve), pa.int32()), pa.array(curve_keys(unit, curve)), batch.column("rep"), batch.column("asks"), code], ["curve", "key", "rep", "asks", "v"])

    both = rows.select("rep", F.lit(False).alias("asks"), "v").union(queries.select("rep", F.lit(True), "v"))
    lines = both.mapInArrow(keyed, "curve int, key long, rep long, asks boolean, v binary")
    lines = lines.repartitionByRange(common.parts_for(lines), "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curves, asks = batch.column("curve").to_numpy(), np.array(batch.column("asks").to_pylist(), bool)
            place = np.empty(len(curves), np.int64)
            for c in np.unique(curves):
                mine = curves == c
                place[mine] = seen.get(int(c), 0) + np.cumsum(~asks[mine])
                seen[int(c)] = int(place[mine][-1])
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(np.full(len(curves), part), pa.int32()), pa.array(place), batch.column("rep"), batch.column("asks"), batch.column("v")], ["curve", "part", "place", "rep", "asks", "v"])

    placed = common.written(lines.mapInArrow(numbered, "curve int, part int, place long, rep long, asks boolean, v binary"), "curves")
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("curve", "part").agg(F.max("place").alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    return placed.join(first, ["curve", "part"]).select("curve", F.greatest(F.lit(0), F.col("first") + F.col("place") - 1).alias("at"), "rep", "asks", "v")


def _window_finds(placed: DataFrame, width: int, block: int, reach: int, last: int, k: int) -> DataFrame:
    """(q, c, score): the k best that each block of the curves holds for queries at most `reach` blocks away; `last` is a curve's last block."""
    own = F.floor(F.col("at") / block)
    met = F.when(F.col("asks"), F.sequence(F.greatest(F.lit(0), own - reach), F.least(F.lit(last), own + reach))).otherwise(F.array(own))
    windows = placed.select("curve", F.explode(met).alias("window"), "asks", "rep", "v")
    windows = windows.repartition(common.parts_for(placed), "curve", "window").sortWithinPartitions("curve", "window", "asks", "rep")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, held, asked, asks, rows = None, [], [], [], [], None

        def answer() -> pa.RecordBatch:
            nonlocal rows
            if rows is None:
                rows = np.array(ids, np.int64), decoded(held, width)
                held.clear()
            q, c, s = [], [], []
            for a, row in zip(asked, decoded(asks, width) @ rows[1].T):
                top = best(row, rows[0], k)
                q.append(np.full(len(top), a)), c.append(rows[0][top]), s.append(row[top].astype("<f8"))
            asked.clear(), asks.clear()
            return _found(q, c, s)

        for batch in batches:
            for curve, window, ask, rep, v in zip(*(batch.column(x).to_pylist() for x in ("curve", "window", "asks", "rep", "v"))):
                if (curve, window) != here:
                    if asked:
                        yield answer()
                    here, ids, held, rows = (curve, window), [], [], None
                (asked if ask else ids).append(rep)
                (asks if ask else held).append(v)
                if len(asked) == ASKED_AT_ONCE:
                    yield answer()
        if asked:
            yield answer()

    return windows.mapInArrow(search, "q long, c long, score double")


def _search(one: DataFrame, queries: DataFrame, width: int, kind: str, k: int) -> DataFrame:
    """(q, c, score): the k best rows(rep, v, norm) found for each of queries(rep, v), in windows as wide as the finds ask for, by the exact measure."""
    size, most = one.agg(F.count("*"), F.max("norm")).first()
    placed = _placed(one, queries, width, kind, most)
    by, keep = Window.partitionBy("q").orderBy(F.desc("score"), "c"), k + MORE
    block, reach, met = BLOCK, 1, None
    while True:
        last = (size - 1) // block
        finds = _window_finds(placed, width, block, reach, last, keep).groupBy("q", "c").agg(F.max("score").alias("score"), F.count("*").alias("times"))
        finds = common.written(finds.withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep), "finds")
        met = finds.select("q", "c", "score") if met is None else met.union(finds.select("q", "c", "score"))
        if reach >= last:
            break
        seen = finds.where((F.col("r") >= k // 2) & (F.col("r") <= k)).groupBy("q").agg(F.avg("times").alias("times"), F.max("r").alias("r"))
        seen = queries.select(F.col("rep").alias("own")).join(seen, F.col("own") == seen["q"], "left").select("own", F.when(F.col("r") == k, F.col("times")).otherwise(0.0).alias("times"))
        if (seen.agg(F.avg("times")).first()[0] or 0.0) >= REPEATED * CURVES:
            break
        doubtful = common.written(queries.select("rep").join(seen.where(F.col("times") < REPEATED * CURVES), F.col("rep") == F.col("own"), "left_semi"), "doubtful")
        queries = doubtful
        placed = placed.where(~F.col("asks")).union(placed.where("asks").join(doubtful, "rep", "left_semi").select(placed.columns))
        if block < MOST_ROWS:
            block *= WIDER
        else:
            reach *= WIDER
    top = met.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep).select("q", "c")
    exact = _exact(top, one, width, kind).withColumn("r", F.row_number().over(by))
    return exact.where(F.col("r") <= k).select("q", "c", "score")


def _exact(pairs: DataFrame, one: DataFrame, width: int, kind: str) -> DataFrame:
    """(q, c, score): inner products, in double precision, of the original vectors of pairs(q, c); a query's vector comes before its finds'."""
    held = pairs.join(one.select(F.col("rep").alias("c2"), "v"), F.col("c") == F.col("c2")).select("q", "c", "v")
    asks = one.join(pairs.select(F.col("q").alias("q2")).distinct(), F.col("rep") == F.col("q2")).select(F.col("rep").alias("q"), F.lit(None).cast("long").alias("c"), "v")
    rows = held.union(asks).repartition(common.parts_for(one), "q").sortWithinPartitions("q", F.col("c").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(width)
        for batch in batches:
            v, c = _matrix(batch.column("v"), width, kind), batch.column("c")
            find = np.asarray(c.is_valid())
            of = np.cumsum(~find)
            mine = np.vstack((last[None, :], v[~find]))
            last = mine[-1]
            score = np.einsum("ij,ij->i", v[find], mine[of[find]])
            yield pa.RecordBatch.from_arrays([batch.column("q").filter(pa.array(find)), c.filter(pa.array(find)), pa.array(score)], ["q", "c", "score"])

    return rows.mapInArrow(run, "q long, c long, score double")


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(rep, ids, v, norm): the different vectors of rows(vec_id, v, norm), numbered in the order of their smallest ids, with their `most` smallest ids; written.

    Only that many rows of a vector leave a task, however common it is.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    one = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.max("norm").alias("norm")).withColumn("first", F.col("ids")[0])
    one = one.repartitionByRange(common.parts_for(rows), "first", "v").sortWithinPartitions("first", "v")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part), pa.int32()), "place": pa.array(np.arange(seen, seen + n))} | {c: batch.column(c) for c in ("ids", "v", "norm")})
            seen += n

    one = common.written(one.mapInArrow(numbered, "part int, place long, ids array<long>, v binary, norm double"), "vectors")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    first = one.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return one.join(F.broadcast(first), "part").select((F.col("before") + F.col("place")).alias("rep"), "ids", "v", "norm")


def _of_width(rows: DataFrame, width: int, k: int, every: int) -> DataFrame:
    """The result for vectors of one length."""
    kind = "<f4" if "array<float>" in dict(rows.dtypes)["e"] else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("e").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in (v + 0.0).astype(kind)], pa.binary()), pa.array(np.sqrt((v * v).sum(1)))], ["vec_id", "v", "norm"])

    rows = common.written(rows.where(F.size("e") == width).mapInArrow(packed, "vec_id long, v binary, norm double"), "vector-rows")
    one = _distinct(rows, k + 1)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    asked = common.written(asked.join(one.select("v", "rep"), F.col("w") == F.col("v")).select("query_id", "rep"), "asked")
    queries = common.written(one.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), "queries")
    top = _search(one, queries, width, kind, k + 1)
    hits = top.join(one.select(F.col("rep").alias("c2"), "ids"), F.col("c") == F.col("c2")).select("q", "c", "score", F.explode("ids").alias("id"))
    # k + 1 ids of k + 1 vectors at most; a query's own row goes once, and where it isn't among the best, the last of them.
    hits = hits.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "c"))), 1, k + 1).alias("best"))
    mine = F.array_position(F.transform("best", lambda b: F.struct(b["id"].alias("id"), b["c"].alias("c"))), F.struct(F.col("query_id").alias("id"), F.col("rep").alias("c")))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("mine")), 1, k)
    ranked = asked.join(hits, asked["rep"] == hits["q"]).withColumn("mine", mine).select("query_id", F.posexplode(others).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows of null vec_id; a query meets the rows of its own length. Every other row is a
    candidate, also one of the same vec_id or the same vector, and a repeated row is a
    query as often as it stands. With fewer than k candidates all are given. Ties go to
    the smaller vec_id. Other columns are not read. An empty table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    widths = sorted(r["w"] for r in rows.select(F.size("e").alias("w")).distinct().collect())  # a row a length
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, width in enumerate(widths):
        found = _of_width(rows, width, k, every)
        out = out.union(found) if i else found
    return out
