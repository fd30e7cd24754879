"""Exact quantiles by distributed selection, in memory that depends on nothing but a bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.storage import dropped, stored

#: Rows of a bucket that are ranked by sorting them, and bits that a pass over larger ones looks at.
SORTED, DIGIT = 65_536, 16


@F.arrow_udf(LongType())
def _code(values: pa.Array) -> pa.Array:
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # a zero has no sign
    bits = x.view(np.int64)
    code = np.where(bits < 0, -(bits & np.iinfo(np.int64).max), bits)
    code[np.isnan(x)] = (2047 << 52) + 1
    return pa.array(code, mask=values.is_null().to_numpy(zero_copy_only=False))


def ordered_code(x: Column) -> Column:
    """A 64-bit integer for a double, in the order of doubles: its bits, which Spark has no function for, so they go through Arrow; zeros are equal, infinities outermost, NaN last; null stays null."""
    return _code(x.cast("double"))


def quantiles(rows: DataFrame, value: Column, shares: dict[str, float], by: Column | None = None) -> DataFrame:
    """(group, one column for each of `shares`): quantiles of a value, interpolated between its two neighbours, of all rows or of each group `by`.

    Values become codes whose order is theirs. Each pass counts, with partial sums before
    the shuffle, the rows of a bucket by the next DIGIT bits of their codes, and keeps the
    buckets that hold a wanted rank; when the kept ones have at most SORTED rows their rows
    are sorted. So no task gathers the values of a group, however many rows it has, and
    four passes are the most. Null values do not count; a group without a value, and an
    empty table, gives null. Values and codes are stored once, and a pass reads them.
    """
    names = list(shares)
    base = rows.select((F.lit(0) if by is None else by).alias("g"), value.cast("double").alias("v"))
    base = stored(base.withColumn("code", ordered_code(F.col("v"))), "codes")
    groups = base.select("g").distinct() if by is not None else base.sparkSession.range(1).select(F.lit(0).alias("g"))
    every, base = base, base.where(F.col("v").isNotNull())
    counts = base.groupBy("g").agg(F.count("*").alias("size"))
    position = F.element_at(F.array(*(F.lit(float(shares[n])) for n in names)), F.col("which") + 1) * (F.col("size") - 1)
    wanted = counts.select("g", "size", F.explode(F.array(*(F.lit(i) for i in range(len(names))))).alias("which")).withColumn("at", position)
    wanted = wanted.withColumn("end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank", F.when(F.col("end") == 0, F.floor("at")).otherwise(F.ceil("at")).cast("long"))
    kept = ("g", "which", "end", "at")
    wanted = stored(wanted.select(*kept, "rank", "size", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("double").alias("found")), "ranks")
    shift, tables = 64, [wanted]

    def inside(of: DataFrame) -> DataFrame:
        """The rows of the buckets that are still open."""
        b = of.where("found IS NULL").select(F.col("g").alias("bg"), "bucket").distinct()
        own = F.shiftright("code", shift) if shift < 64 else F.lit(0).cast("long")
        return base.withColumn("own", own).join(b, F.col("g").eqNullSafe(F.col("bg")) & (F.col("own") == F.col("bucket"))).select("g", "bucket", "v", "code")

    while shift and not wanted.where((F.col("size") > SORTED) & F.col("found").isNull()).isEmpty():
        open_, shift = inside(wanted), shift - DIGIT
        held = open_.groupBy("g", "bucket", F.shiftright("code", shift).alias("digit")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        ahead = F.sum("n").over(Window.partitionBy("g", "bucket").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")  # of 2^DIGIT rows
        held = held.withColumn("ahead", ahead).select(F.col("g").alias("hg"), F.col("bucket").alias("hb"), "digit", "n", "low", "high", "ahead")
        met = wanted.where("found IS NULL").join(held, F.col("g").eqNullSafe(F.col("hg")) & (F.col("bucket") == F.col("hb")) & (F.col("rank") >= F.col("ahead")) & (F.col("rank") < F.col("ahead") + F.col("n")))
        met = met.select(*kept, (F.col("rank") - F.col("ahead")).alias("rank"), F.col("n").alias("size"), F.col("digit").alias("bucket"), F.when((F.col("low") == F.col("high")) | (F.isnan("low") & F.isnan("high")), F.col("low")).alias("found"))
        wanted = stored(wanted.where("found IS NOT NULL").union(met.select(*wanted.columns)), "ranks")
        tables.append(wanted)
    order = Window.partitionBy("g", "bucket").orderBy("code")
    ranked = inside(wanted).withColumn("place", F.row_number().over(order) - 1).select(F.col("g").alias("rg"), F.col("bucket").alias("rb"), "place", "v")
    met = wanted.where("found IS NULL").join(ranked, F.col("g").eqNullSafe(F.col("rg")) & (F.col("bucket") == F.col("rb")) & (F.col("rank") == F.col("place"))).select(*kept, F.col("v").alias("found"))
    both = stored(wanted.where("found IS NOT NULL").select(*kept, "found").union(met), "quantiles")
    groups = stored(groups, "groups")
    for table in (*tables, every):
        dropped(table)
    low, high = F.max(F.when(F.col("end") == 0, F.col("found"))), F.max(F.when(F.col("end") == 1, F.col("found")))
    part = F.max("at") - F.floor(F.max("at"))
    one = both.groupBy("g", "which").agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias("q"))
    wide = one.groupBy("g").agg(*(F.max(F.when(F.col("which") == i, F.col("q"))).alias(n) for i, n in enumerate(names)))
    out = groups.withColumnRenamed("g", "group").join(wide, F.col("group").eqNullSafe(F.col("g")), "left").drop("g")
    return out if by is not None else out.drop("group")
