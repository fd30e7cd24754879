"""Mixing sources to target weights by a time-varying curriculum.

Training time u runs from 0 to 1. Source s asks at rate T_s * d_s(u), where T_s is its
target in words and d_s a linear schedule of mean 1, so its cumulative demand is
D_s(u) = T_s * ((1 - b_s / 2) u + b_s u^2 / 2), with slope b_s between -1 and 1. A
source's documents are laid end to end in a fixed pseudo-random order, again and again
if the target asks for repeats; the copy whose middle lies at word x of that line is
taken if x < T_s, and trained on at u = D_s^-1(x), in closed form. Sorting by u mixes
the sources as the schedules say at every moment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = r"[^\x20\x09-\x0D]+"
#: Share of all words that the mix asks for, and the weights that sources take in turn.
SHARE, WEIGHTS, REPEATS = 1.5, (3, 1, 2), 2
#: Ranges of a source's order, at least, and the bytes of a table from which there are more.
BUCKETS, BUCKET_BYTES = 1024, 64 << 20
#: Hexadecimal digits of the order by which ranges are cut.
DIGITS = 6


def sizes(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORDS)), F.lit(0)).cast("long")


def drift(source: Column) -> Column:
    """The slope of a source's schedule where none is given: fixed by its name, from -1 to 1."""
    return (F.conv(F.substring(F.md5(F.coalesce(source.cast("string"), F.lit("null"))), 1, 4), 16, 10).cast("int") % 2001 - 1000) / 1000.0


def _order(ident: Column, text: Column) -> Column:
    """A fixed pseudo-random order of ids; null ids go by their texts."""
    return F.md5(F.coalesce(ident.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit(""))))))


def _bucket(key: Column, buckets: int) -> Column:
    """The range of the order that holds a key: `buckets` equal ranges, ascending with the key."""
    return F.floor(F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("long") * buckets / 16**DIGITS).cast("int")


def targets(by_source: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights by code point of the source, null last.

    A target stops at `repeats` times its source's size and the excess is dealt again
    by weight until none is above: with sources ordered by cap / weight, the level is
    the first at which what remains, divided by the remaining weights, is below the
    next cap / weight. One row per source; the windows see those rows only.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((turn - 1) % len(weights) + 1).cast("int"))
    rows = by_source.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * float(repeats))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    rows = (
        rows.withColumn("want", F.sum("source_size").over(every) * share)
        .withColumn("full", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", (F.col("want") - F.col("full")) / F.col("left"))
        .withColumn("fits", F.col("cap") >= F.col("rate") * F.col("w"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "rate"))).over(every)["rate"])
    )
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def _line(rows: DataFrame, sums: DataFrame, schedule: Callable[[Column], Column], keep: tuple[str, ...]) -> DataFrame:
    """rows(source, key, bucket, id, size, ...) with source_size, target, copies and positions, from sums(source, bucket, n)."""
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size"))).withColumnRenamed("source", "g")
    base = offsets.join(goals.select("g", "source_size", "target", schedule(F.col("g")).alias("slope")), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.withColumn("inside", F.sum("size").over(within) - F.col("size")).join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    middle = lambda k: F.col("before") + F.col("inside") + F.col("size") / 2 + k * F.col("source_size")
    b = F.col("slope")
    at = lambda x: F.when(F.abs(b) < 1e-9, x / F.col("target")).otherwise((F.sqrt((1 - b / 2) * (1 - b / 2) + 2 * b * x / F.col("target")) - (1 - b / 2)) / b)
    copies = sum((F.when(middle(k) < F.col("target"), 1).otherwise(0) for k in range(1, REPEATS)), F.when(middle(0) < F.col("target"), 1).otherwise(0))
    positions = F.filter(F.array(*(F.when(middle(k) < F.col("target"), at(middle(k))) for k in range(REPEATS))), lambda x: x.isNotNull())
    return line.select(*keep, "size", "source_size", "target", copies.alias("copies"), positions.alias("positions"))


def _buckets(docs: DataFrame) -> int:
    """Ranges of a source's order: one for each BUCKET_BYTES of the table, BUCKETS at least, and never more than the digits tell apart."""
    size = common.plan_bytes(docs)
    return min(16**DIGITS, max(BUCKETS, size // BUCKET_BYTES if size < 1 << 50 else 0))


def plan(docs: DataFrame, buckets: int | None = None, schedule: Callable[[Column], Column] = drift) -> DataFrame:
    """What the mix takes of every row of docs(doc_id, text, source).

    Returns doc_id, size, source_size, target, taken, copies and positions (one u in
    [0, 1) for each copy). `schedule` gives the slope of a source's linear schedule, from
    -1 (early) to 1 (late). Null and empty texts have size 0; a null source is a source.
    Ties and repeated rows follow each other in one order, equal rows in any. Other
    columns are not read. An empty table gives no row. A source's running sum is taken
    within `buckets` ranges of its order and added over the ranges, so that no task
    holds a source, however many of all rows it has; their number changes no result.
    Words are counted once and the sizes stored.
    """
    key = _order(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), sizes().alias("size"), key.alias("key"))
    rows = common.written(rows.withColumn("bucket", _bucket(F.col("key"), buckets or _buckets(docs))), "sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    line = _line(rows, sums, schedule, ("id",))
    return line.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "positions")


def curriculum(docs: DataFrame, schedule: Callable[[Column], Column] = drift) -> DataFrame:
    """plan(docs), range-sorted by training position, with first_at and last_at (null where nothing is taken) and training_rank.

    training_rank numbers the rows from 1 by the position of their first copy; rows of
    which nothing is taken come last; ties go by doc_id, nulls first, then by size. Tasks
    number the rows of their range, and the ranges' row counts, one a task, are added up.
    """
    rows = plan(docs, schedule=schedule)
    rows = rows.withColumns({"first_at": F.array_min("positions"), "last_at": F.array_max("positions")}).drop("positions")
    order = (F.col("first_at").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("size").asc())
    rows = rows.repartitionByRange(common.parts_for(docs), *order).sortWithinPartitions(*order)
    rows = common.written(rows.withColumn("place", F.monotonically_increasing_id()), "curriculum")
    part = F.shiftright("place", 33)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = rows.join(F.broadcast(counts), part == F.col("part"))  # a row for each task of the sort
    return ranked.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_at", "last_at", (F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("training_rank"))


def apply(docs: DataFrame, schedule: Callable[[Column], Column] = drift) -> DataFrame:
    """The training order: docs with each row as often as the mix takes it, range-sorted by position.

    Documents without a word, null texts too, take no part in the sums; they are kept
    once. Every row goes by its own positions, rows of one id or null ids too; equal rows
    take theirs in any order. Columns, their types and values stay, whatever their names.
    """
    buckets = _buckets(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = _order(F.col("row.doc_id"), F.col("row.text"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.col("row.source").cast("string").alias("source"), sizes(F.col("row.text")).alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    line = _line(rows, sums, schedule, ("row", "id"))
    place = F.when(F.col("size") == 0, F.array(F.coalesce(F.get("positions", F.lit(0)), F.lit(0.0)))).otherwise(F.col("positions"))
    placed = line.select("row", "id", F.explode(place).alias("u"))
    return placed.repartitionByRange(common.parts_for(docs), "u", "id").sortWithinPartitions("u", "id").select("row.*")
