"""Statistics of errors and slopes, histograms over the data's range, running offsets, counts of what a filter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .quantiles import quantiles


def deviation_stats(rows: DataFrame, d: Column, by: Column | None = None) -> DataFrame:
    """coverage (share of rows with a value), rms, p95, p99, most and mean of deviations, by band if one is given; percentiles by selection, so that no band's values meet in a task."""
    kept = stored(rows.select((F.lit(0) if by is None else by).alias("band"), d.alias("d")), "deviations")
    d = F.col("d")
    out = kept.groupBy("band").agg(F.avg(d.isNotNull().cast("int")).alias("coverage"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(d).alias("most"), F.avg(d).alias("mean"))
    tails = quantiles(kept, d, {"p95": 0.95, "p99": 0.99}, F.col("band"))
    both = out.join(tails, F.col("band").eqNullSafe(F.col("group"))).select("band", "coverage", "rms", "p95", "p99", "most", "mean")
    if by is not None:
        return both
    return both.drop("band") if not kept.isEmpty() else rows.agg(*(F.lit(None).cast("double").alias(c) for c in both.columns[1:]))


def slope_asymmetry(rows: DataFrame, slope: Column, steep: float) -> DataFrame:
    """up, down: 95th percentile of climbing and of dropping slopes in degrees; steep_up, steep_down: their shares above `steep`."""
    kept = stored(rows.select(slope.alias("s")), "slopes")
    side = F.when(F.col("s") > 0, "up").when(F.col("s") < 0, "down")
    size = F.abs("s")
    tails = quantiles(kept.where(side.isNotNull()), size, {"p95": 0.95}, side)
    angle = lambda k: F.max(F.when(F.col("group") == k, F.degrees(F.atan("p95")))).alias(k)
    share = lambda k: F.avg(F.when(side == k, (size > steep).cast("int"))).alias(f"steep_{k}")
    return tails.agg(angle("up"), angle("down")).join(kept.agg(share("up"), share("down")), F.lit(True))  # a row each


def wind_slopes(raster: DataFrame, edge: float, wind: tuple[float, float]) -> DataFrame:
    """(i, j, slope): raster(i, j, h) along the wind (x, z), rows i along z: central differences inside, one-sided ones at the rim.

    A stencil by one shuffle: each cell gives its height to its four neighbours and itself,
    and a cell adds up what it gets. A neighbour that the raster does not have counts as rim.
    """
    to = lambda di, dj, axis: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(axis).alias("axis"), F.lit(-di - dj).alias("side"))
    spread = raster.select(F.explode(F.array(to(0, 0, "own"), *(to(d, 0, "z") for d in (-1, 1)), *(to(0, d, "x") for d in (-1, 1)))).alias("to"), "h").select("to.*", "h")
    of = lambda axis, side: F.max(F.when((F.col("axis") == axis) & (F.col("side") == side), F.col("h")))
    cells = spread.groupBy("i", "j").agg(of("own", 0).alias("h"), *(of(a, s).alias(f"{a}{n}") for a in "xz" for s, n in ((-1, "lo"), (1, "hi")))).where(F.col("h").isNotNull())

    def diff(a: str) -> Column:
        low, high = F.coalesce(F.col(f"{a}lo"), F.col("h")), F.coalesce(F.col(f"{a}hi"), F.col("h"))
        steps = F.col(f"{a}lo").isNotNull().cast("int") + F.col(f"{a}hi").isNotNull().cast("int")
        return F.when(steps > 0, (high - low) / (steps * edge)).otherwise(0.0)

    return cells.select("i", "j", (diff("x") * wind[0] + diff("z") * wind[1]).alias("slope"))


def range_histogram(points: DataFrame, bins: int = 800) -> DataFrame:
    """(i, j, n): counts of points(x, y) in equal bins over the data's range, the last ones closed."""
    edges = points.agg(*(f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    width = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")).otherwise(1.0)
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / width(c) * bins), F.lit(bins - 1)).cast("int")
    inside = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return inside.crossJoin(F.broadcast(edges)).groupBy(place("x").alias("i"), place("y").alias("j")).agg(F.count("*").alias("n"))  # edges: one row


def _by_ranges(rows: DataFrame, keys: list[str], sizes: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `place` (from 0) and for every size c `c_at`, the sum of it before a row in the order of the keys; and one row of the number of rows, rows_, and of whole sums.

    Rows are range-partitioned and stored with the number of their range; sums go over
    ranges first, whose number is that of tasks, then within each range. The rows
    themselves are joined with nothing but the sums of ranges.
    """
    cut = stored(rows.repartitionByRange(*keys).withColumn("block_", F.spark_partition_id()), "offsets")
    sums = cut.groupBy("block_").agg(F.count("*").alias("rows_"), *(F.sum(F.col(c).cast("long")).alias(c) for c in sizes))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("block_").alias("b_"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead_") for c in ("rows_", *sizes)))
    inside = Window.partitionBy("block_").orderBy(*keys)
    held = cut.withColumns({"place": F.row_number().over(inside) - 1} | {f"{c}_at": F.sum(F.col(c).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c) for c in sizes})
    held = held.join(F.broadcast(ahead), F.col("block_") == F.col("b_"))  # a row a range
    out = held.select(*rows.columns, (F.col("rows__ahead_") + F.col("place")).alias("place"), *((F.col(f"{c}_ahead_") + F.col(f"{c}_at")).alias(f"{c}_at") for c in sizes))
    return out, sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_", *sizes)))


def numbered(rows: DataFrame, keys: list[str], sizes: list[str]) -> tuple[DataFrame, list[int]]:
    """rows with `place` and `c_at` for every size c, as in `running_offsets`, and how many rows there are and the whole sums."""
    out, whole = _by_ranges(rows, keys, sizes)
    return out, list(whole.first())


def running_offsets(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with `place` (from 0) and `starts`, the sum of the sizes before a row in key order, and one row more with null keys, the number of rows and the whole sum."""
    names = [f"key{i}" for i in range(len(keys))]
    out, whole = _by_ranges(rows.select(*(F.col(k).alias(c) for k, c in zip(keys, names)), F.col(size).cast("long").alias("size")), names, ["size"])
    out = out.select(*(F.col(c).alias(k) for k, c in zip(keys, names)), "place", F.col("size_at").alias("starts"))
    return out.unionByName(whole.select(*(F.lit(None).cast(dict(out.dtypes)[k]).alias(k) for k in keys), F.col("rows_").alias("place"), F.col("size").alias("starts")))


def counted(rows: DataFrame, name: str, **of: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what the pass that an action makes over them saw: n, and how many meet each condition."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in of.items())), seen


def watched(rows: DataFrame, kept: Column, name: str) -> tuple[DataFrame, Observation]:
    """The rows that are kept, and what one pass over all saw: n, kept and pct, once an action has run."""
    seen = Observation(name)
    k = F.count_if(F.coalesce(kept, F.lit(False)))
    out = rows.observe(seen, F.count("*").alias("n"), k.alias("kept"), F.try_divide(100.0 * k, F.count("*")).alias("pct"))
    return out.where(F.coalesce(kept, F.lit(False))), seen
