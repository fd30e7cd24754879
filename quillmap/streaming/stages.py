"""An extension: the stateless entity stages over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims as C
from ..sources.dumps import entities, prefilter


def figures_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Figures from every text file that comes into a folder, by the same expressions as the batch stage."""
    lines = spark.readStream.text(folder).select(F.regexp_replace(F.trim("value"), ",+$", "").alias("value")).where(~F.col("value").isin("", "[", "]"))
    e = entities(lines, strict=False)
    rows = e.where(C.is_figure(F.col("e"), F.col("c"))).select(*(c.alias(k) for k, c in C.figure_row(F.col("e"), F.col("c")).items()))
    return prefilter(rows)
