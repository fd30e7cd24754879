"""K-means over integer vectors by kd-tree filtering.

Each partition's vectors go into kd-trees, of TREE vectors at a time, split at the median
of the widest side down to leaves of LEAF. The leaves are stored once, in tree order,
with their counts, integer sums and boxes; the nodes above them are unions of neighbours
and made again as leaves are read, so any run of leaves is a forest.

A round descends from the roots with all centroids as candidates. A node's candidate
nearest to the middle of its box stays; another one goes if even the corner of the box
that lies farthest its way is strictly farther from it. A node with one candidate left is
assigned whole, by its count and sums; vectors are only read in leaves that keep several.
Tasks return a count and sums for each centroid, which Spark adds up: the driver holds
nothing but the centroids. All arithmetic is on integers, so results do not depend on
partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, TREE, LEAF = 64, 8192, 32
#: Vectors of a leaf of equal ones.
EQUAL = 256
#: Components below this keep the sums of 64 squares that a descent compares within 64 bits.
LARGEST = 1 << 25
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def leaves_of(v: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of v as leaves in tree order: halves at the median of the side along which they spread most."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        mine = v[rows]
        if len(rows) <= size or (mine == mine[0]).all():
            out += [rows[i : i + EQUAL] for i in range(0, len(rows), EQUAL)]
            continue
        side = int((mine.max(0) - mine.min(0)).argmax())
        order = np.argsort(mine[:, side], kind="stable")
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles as long as those hold every sum."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if a.shape[-1] * most[0] * most[1] < 1 << 53:
        return (a.astype("<f8") @ b.T.astype("<f8")).astype(np.int64)
    return a @ b.T


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    return (v * v).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * _products(v, centroids)


def undominated(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each box's candidates (rows of `left`) those that are not strictly farther than the one nearest to its middle, at every point of the box."""
    far = np.iinfo(np.int64).max
    middle = np.where(left, squared(lo + hi, 2 * centroids), far).argmin(1)
    kept = left.copy()
    norms = (centroids * centroids).sum(1)
    for z, at in enumerate(centroids):
        rows = np.flatnonzero(left[:, z] & (middle != z))
        best = centroids[middle[rows]]
        way = at - best
        corner = np.where(way > 0, hi[rows], lo[rows])
        kept[rows, z] = norms[z] - norms[middle[rows]] - 2 * (way * corner).sum(1) <= 0
    return kept


def descend(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """(level, nodes, centroid of each) that were assigned whole, and the candidates of every leaf (none below those nodes).

    Node i of a level holds the leaves from i << level up to (i + 1) << level.
    """
    levels = [(lo, hi)]
    while len(levels[-1][0]) > 1:
        a, b = levels[-1]
        starts = np.arange(0, len(a), 2)
        levels.append((np.minimum.reduceat(a, starts), np.maximum.reduceat(b, starts)))
    nodes, left, whole = np.arange(len(levels[-1][0])), np.ones((len(levels[-1][0]), len(centroids)), bool), []
    open_ = np.zeros((len(lo), len(centroids)), bool)
    for level in range(len(levels) - 1, -1, -1):
        left = undominated(levels[level][0][nodes], levels[level][1][nodes], centroids, left)
        one = left.sum(1) == 1
        whole.append((level, nodes[one], left[one].argmax(1)))
        nodes, left = nodes[~one], left[~one]
        if level:
            nodes = (2 * nodes[:, None] + (0, 1)).ravel()
            left = np.repeat(left, 2, 0)
            there = nodes < len(levels[level - 1][0])
            nodes, left = nodes[there], left[there]
    open_[nodes] = left
    return whole, open_


class Leaves:
    """The leaves of a batch as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int = WIDTH):
        table = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(-1, width).astype(np.int64)
        self.count, self.lo, self.hi, self.total = batch.column("n").to_numpy(), table("lo", "<i4"), table("hi", "<i4"), table("total", "<i8")
        self.packed, self.width = batch.column("v"), width

    def vectors(self, which: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self.packed.take(pa.array(which)).to_pylist()), "<i4").reshape(-1, self.width).astype(np.int64)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors go to each centroid, and their sums."""
        whole, open_ = descend(self.lo, self.hi, centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        count = np.concatenate(([0], np.cumsum(self.count)))
        ahead = np.concatenate((np.zeros((1, self.width), np.int64), np.cumsum(self.total, 0)))
        for level, nodes, to in whole:
            start, stop = nodes << level, np.minimum((nodes + 1) << level, len(self.count))
            np.add.at(n, to, count[stop] - count[start])
            np.add.at(total, to, ahead[stop] - ahead[start])
        rest = np.flatnonzero(open_.any(1))
        if len(rest):
            v = self.vectors(rest)
            to = self._nearest(v, centroids, np.repeat(open_[rest], self.count[rest], 0))
            for z in range(len(centroids)):
                n[z] += (to == z).sum()
                total[z] += v[to == z].sum(0)
        return n, total

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance."""
        whole, open_ = descend(self.lo, self.hi, centroids)
        for level, nodes, to in whole:
            for i, z in zip(nodes, to):
                open_[i << level : (i + 1) << level, z] = True
        v = self.vectors(np.arange(len(self.count)))
        to = self._nearest(v, centroids, np.repeat(open_, self.count, 0))
        return to, ((v - centroids[to]) ** 2).sum(1)

    @staticmethod
    def _nearest(v: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.where(left, squared(v, centroids), np.iinfo(np.int64).max).argmin(1)


def planted(rows: DataFrame, scale: int, width: int = WIDTH) -> DataFrame:
    """(ids, n, v, total, lo, hi): the leaves of the trees over rows(vec_id, e), written in tree order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def trees(least: int) -> Iterator[pa.RecordBatch]:
            while len(ids) > least:
                v = np.concatenate(held) if len(held) > 1 else held[0]
                mine, v, rest = ids[:TREE], v[:TREE], v[TREE:]
                ids[:], held[:] = ids[TREE:], [rest]
                cut = leaves_of(v)
                of = lambda f: pa.array([f(v[rows]).tobytes() for rows in cut], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([[mine[i] for i in rows] for rows in cut], pa.list_(pa.int64())), "n": pa.array([len(rows) for rows in cut], pa.int64()), "v": of(lambda x: x.astype("<i4")),
                    "total": of(lambda x: x.sum(0).astype("<i8")), "lo": of(lambda x: x.min(0).astype("<i4")), "hi": of(lambda x: x.max(0).astype("<i4")),
                })

        for batch in batches:
            x = np.floor(np.asarray(batch.column("e").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(batch), width) * scale)
            if np.abs(x).max(initial=0) >= LARGEST:
                raise ValueError(f"components from {LARGEST // scale} on give distances beyond 64 bits")
            ids += batch.column("vec_id").to_pylist()
            held.append(x.astype(np.int64))
            yield from trees(TREE)
        yield from trees(0)

    return common.written(rows.mapInArrow(run, "ids array<long>, n long, v binary, total binary, lo binary, hi binary"), "kd-leaves")


def moved(leaves: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor(sum / count), those without a vector as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if len(batch):
                more = Leaves(batch, centroids.shape[1]).sums(centroids)
                n, total = n + more[0], total + more[1]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"z": pa.array(at, pa.int32()), "n": pa.array(n[at]), "total": pa.array(total[at].tolist(), pa.list_(pa.int64()))})

    parts = leaves.select("n", "v", "total", "lo", "hi").mapInArrow(run, "z int, n long, total array<long>")
    sums = parts.select("z", "n", F.posexplode("total").alias("i", "x")).groupBy("z", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # centroids x components
        out[r["z"], r["i"]] = r["x"] // r["n"]
    return out


def _first(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:vec_id`; ties by components, rows of null id last."""
    ints = F.transform("e", lambda x: F.floor(x.cast("double") * scale))
    key: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in rows.select(key.alias("key"), ints.alias("v")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()], np.int64)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `width` finite components, as integers floor(scale * x).

    Centroids start as the k vectors of smallest sha256 of `seed:vec_id`, fewer if there
    are fewer; equal ones stay apart, and the smaller number wins every tie. Null
    vectors, other lengths, null and non-finite components are left out. Repeated rows
    count each; rows of null vec_id are clustered and start as centroids last. Components
    whose distances could leave 64 bits are an error. Other columns are not read. An empty
    table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where((F.size("embedding") == width) & common.finite(F.col("embedding")))
    centroids = _first(rows, k, seed, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], RESULT)
    leaves = planted(rows, scale, width)
    for _ in range(rounds):
        centroids = moved(leaves, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                to, d = Leaves(batch, width).assigned(centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("ids").flatten(), "cluster": pa.array(to, pa.int32()), "distance": pa.array(d)})

    placed = common.written(leaves.mapInArrow(run, "vec_id long, cluster int, distance long"), "kd-placed")
    common.dropped(leaves)
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    of = [(z, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[z].tolist())).encode()).hexdigest()) for z, s in sums.items()]
    told = vectors.sparkSession.createDataFrame(of, "z int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), F.col("cluster") == F.col("z")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
