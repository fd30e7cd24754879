"""Layouts of unknown columns, JSON tables, and searches in titles."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

EXTRA = ("death_year", "country_qid", "title", "sitelink_count")


def with_xy(layout: DataFrame) -> DataFrame:
    """x and y as they are, or from radius and angle, beside what there is of four further columns; an error without either pair."""
    names = set(layout.columns)
    if {"x", "y"} <= names:
        xy = [F.col("x").cast("double"), F.col("y").cast("double")]
    elif {"radius", "angle"} <= names:
        xy = [F.col("radius") * F.cos("angle"), F.col("radius") * F.sin("angle")]
    else:
        raise ValueError("a layout needs x and y, or radius and angle; it has " + ", ".join(sorted(names)))
    return layout.select(xy[0].alias("x"), xy[1].alias("y"), *(c for c in EXTRA if c in names))


def find_titles(rows: DataFrame, asked: str, title: str = "title", order: str = "row_idx", most: int = 40) -> DataFrame:
    """The first `most` rows, in order, whose title holds the words asked for, in any case; none for a blank question."""
    asked = asked.strip().lower()
    return rows.where(F.contains(F.lower(title), F.lit(asked)) if asked else F.lit(False)).orderBy(order).limit(most)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array, or the one object of a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def spawns(layout: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, want, qid, title, x, y): each id of wanted(pos, want) with its row of a layout, nulls where there is none."""
    return wanted.join(layout, wanted["want"] == layout["qid"], "left").select("pos", "want", "qid", "title", "x", "y")


def spawn_rows(layout: DataFrame, wanted: list[str]) -> tuple[list[dict], list[str]]:
    """(rows, missing): qid, title, x and y, rounded to one place, of the ids in the order wanted, and the ids without a row."""
    spark = layout.sparkSession
    asks = spark.createDataFrame(list(enumerate(wanted)), "pos int, want string")
    got = spawns(layout, asks).orderBy("pos").collect()
    rows = [{"qid": r["qid"], "title": r["title"], "x": round(r["x"], 1), "y": round(r["y"], 1)} for r in got if r["qid"] is not None]
    return rows, [r["want"] for r in got if r["qid"] is None]


def write_spawn(layout: DataFrame, wanted: list[str], path: str) -> list[str]:
    """The rows as JSON; ids without a row are left out and returned."""
    rows, missing = spawn_rows(layout, wanted)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False, indent=0)
    return missing


def world_constants() -> dict[str, float]:
    """What a viewer needs to turn radii into eras and bytes into sizes."""
    return {"R_INNER": G.R_INNER, "R_MAX": G.R_MAX, "TIME_SPAN": G.SPAN, "RADIUS_ALPHA": 1.0, "REF_YEAR": float(G.NOW), "BOOK_SCALE_MIN": 0.8, "BOOK_SCALE_MAX": 2.6}


def write_world(path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(world_constants(), out)


def sector_top(rows: DataFrame, angle: str, n: int, sectors: int = 24) -> DataFrame:
    """The max(1, n // sectors) rows of most sitelinks of each sector, the first in row_idx order on ties, with `sec` and `k`.

    A row number over a sector, cut at k, keeps k rows of a sector in each task before it shuffles.
    """
    own = rows.withColumn("sec", G.sector(F.col(angle), sectors))
    place = F.row_number().over(Window.partitionBy("sec").orderBy(F.desc(F.coalesce("sitelinks", F.lit(0))), "row_idx"))
    return own.withColumn("k", place).where(F.col("k") <= max(1, n // sectors))


def local_best(rows: DataFrame, exclude: DataFrame, sectors: int = 24, rings: int = 14) -> DataFrame:
    """The row of most sitelinks of each cell of sector and ring of rows(x, y, sitelinks, row_idx), located or not, unless exclude(row_idx) has it."""
    turn, away = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)), F.hypot("x", "y")
    most = rows.agg(F.max(away).alias("rmax"))
    cells = rows.crossJoin(F.broadcast(most)).withColumns({"sec": G.sector(turn, sectors), "ring": G.ring(away, F.col("rmax"), rings)})  # one row
    names = [c for c in rows.columns if c not in ("sec", "ring")]
    best = cells.groupBy("sec", "ring").agg(F.max_by(F.struct(*names), F.struct(F.coalesce("sitelinks", F.lit(0)), -F.col("row_idx"))).alias("b")).select("sec", "ring", "b.*")
    return best.join(exclude.select(F.col("row_idx").alias("out")), F.col("row_idx") == F.col("out"), "left_anti")
