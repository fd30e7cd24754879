"""A stored grid index: points sorted along a curve through cells, and which files hold a cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import required

#: Half the cells a side that the curve numbers.
HALF = 1 << 20


def _spread(x: Column) -> Column:
    """The 32 low bits of a number with a free bit before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve(gx: Column, gy: Column) -> Column:
    """Place of a cell on a Z curve, so that neighbours are mostly near each other; cells beyond HALF share the rim's."""
    inside = lambda g: F.least(F.greatest(g, F.lit(-HALF)), F.lit(HALF - 1)) + HALF
    return _spread(inside(gx)).bitwiseOR(F.shiftleft(_spread(inside(gy)), 1))


def write_index(points: DataFrame, edge: float, path: str, files: int | None = None, ident: str = "id") -> GridIndex:
    """Store points(x, y, ...) under path: `points`, range-sorted along the curve of their cells, and `cells`, the rows and the least x and y of each cell in each file.

    A crowded cell spreads over as many ranges as it needs, as the ident is part of the
    sort key. Null points are left out. `files` is the number of ranges, by default the
    session's number of partitions.
    """
    at = lambda c: F.floor(F.col(c) / edge).cast("long")
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"gx": at("x"), "gy": at("y")}).withColumn("key", curve(F.col("gx"), F.col("gy")))
    by = ("key", "gx", "gy", ident)
    rows = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    rows.sortWithinPartitions(*by).drop("key").write.option("compression", "zstd").parquet(f"{path}/points")
    held = points.sparkSession.read.parquet(f"{path}/points").select("gx", "gy", "x", "y", F.col("_metadata.file_name").alias("file"))
    cells = held.groupBy("gx", "gy", "file").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    cells.withColumn("edge", F.lit(float(edge))).write.parquet(f"{path}/cells")
    return GridIndex(points.sparkSession, path)


class GridIndex:
    """Reads the cells that a question needs: their files, and in those, by the statistics of gx and gy, their row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = spark.read.parquet(required(spark, f"{path}/cells", "index"))
        first = self.cells.select("edge").first()
        self.edge = first["edge"] if first else 1.0
        self.schema = spark.read.parquet(f"{path}/points").schema

    def counts(self) -> DataFrame:
        """(gx, gy, n) of every cell that holds a point, without reading any."""
        return self.cells.groupBy("gx", "gy").agg(F.sum("n").alias("n"))

    def low(self) -> tuple[float, float] | None:
        """The least x and y of all points, without reading any."""
        row = self.cells.agg(F.min("x0"), F.min("y0")).first()
        return None if row[0] is None else (row[0], row[1])

    def box(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        """The points of x0 <= x <= x1 and y0 <= y <= y1, with their cells gx, gy."""
        g = [math.floor(v / self.edge) for v in (x0, x1, y0, y1)]
        meets = F.col("gx").between(g[0], g[1]) & F.col("gy").between(g[2], g[3])
        files = [r["file"] for r in self.cells.where(meets).select("file").distinct().collect()]  # of the cells asked for
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/points/{f}" for f in sorted(files)))
        return rows.where(meets & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))

    def near(self, x: float, y: float, radius: float) -> DataFrame:
        """The points at distance <= radius, with d."""
        rows = self.box(x - radius, y - radius, x + radius, y + radius)
        return rows.withColumn("d", F.hypot(F.col("x") - x, F.col("y") - y)).where(F.col("d") <= radius)
