"""The stages as commands: python -m quillmap.cli STAGE --flags; tables are Parquet, inputs any path that Spark reads."""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anchors, articles, placement, rasters, stats, terrain, topology
from .sources import binaries, dumps, layouts
from .sources.storage import optional, required, stored

#: Half a book's length, and how far books keep from a monument's centre.
HALF_BOOK, CLEAR = 0.29, 2.3


def _table(spark: SparkSession, path: str, what: str) -> DataFrame:
    return spark.read.parquet(required(spark, path, what))


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def figures(spark: SparkSession, a: argparse.Namespace) -> None:
    out = a.out.removesuffix(".parquet") + ".trial.parquet" if a.limit else a.out
    rows, seen = stats.counted(dumps.figures(spark, required(spark, a.dump, "dump"), a.limit), "figures", born=F.col("birth_year").isNotNull())
    _put(rows, out)
    print("kept {n} figures, {born} with a birth year".format(**seen.get))


def prefilter(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _table(spark, a.rows, "figures")
    kept, seen = stats.watched(rows, F.col("death_year") < a.death_year_max, "prefilter")
    _put(kept if a.keep_missing_description else kept.where(F.col("description").isNotNull()), a.out)
    print("kept {kept} of {n} by year ({pct:.1f} %)".format(**{"pct": 0.0} | {k: v for k, v in seen.get.items() if v is not None}))


def read_articles(spark: SparkSession, a: argparse.Namespace) -> None:
    out = dumps.with_articles(_table(spark, a.rows, "figures"), dumps.pages(spark, required(spark, a.dump, "dump"), a.limit))
    out, seen = stats.counted(out, "articles", matched=F.col("lead_text").isNotNull())
    _put(out, a.out)
    print("joined {n} rows, {matched} with article ({pct:.1f} %)".format(pct=100 * seen.get["matched"] / max(1, seen.get["n"]), **seen.get))


def cut(spark: SparkSession, a: argparse.Namespace) -> None:
    words = F.col("article_word_count")
    rows, seen = stats.counted(_table(spark, a.rows, "figures with articles"), "cut", none=words.isNull(), short=words < a.min_article_words)
    _put(articles.quality_cut(rows, a.min_article_words), a.out)
    kept = seen.get["n"] - seen.get["none"] - seen.get["short"]
    print("read {n} rows: {none} without article, {short} under {least} words; kept {kept} ({pct:.1f} %)".format(least=a.min_article_words, kept=kept, pct=100 * kept / max(1, seen.get["n"]), **seen.get))


def places(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _table(spark, a.rows, "figures")
    found, seen = stats.counted(dumps.places(spark, required(spark, a.dump, "dump"), rows, a.limit), "places", located=F.col("lat").isNotNull())
    _put(found, a.out)
    needed = dumps.needed_places(rows).count()
    print("matched {n} places of {needed} needed ({pct:.1f} %), {located} with coordinates".format(needed=needed, pct=100 * seen.get["n"] / max(1, needed), **seen.get))


def place(spark: SparkSession, a: argparse.Namespace) -> None:
    found = placement.locate(_table(spark, a.figures, "figures"), _table(spark, a.places, "places"), binaries.load_gazetteer(a.gazetteer))
    rows = found.withColumns({"sitelinks": F.col("sitelink_count"), "words": F.col("article_word_count"), "row_idx": F.xxhash64("qid")})
    placed, seen = stats.counted(placement.tiers(placement.place(rows, a.seed)), "place", located=F.col("lon").isNotNull(), major=F.col("landmark_tier") == "major")
    _put(placed, a.out)
    print("placed {n} figures, {located} by longitude, {major} major".format(**seen.get))


def monuments(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.anchors, encoding="utf-8") as file:
        lists = [(label, people) for label, people in json.load(file).items()]
    _put(anchors.monuments(spark.createDataFrame(lists, "label string, people array<string>"), _table(spark, a.placement, "placement"), _table(spark, a.places, "places")), a.out)


def relax(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _table(spark, a.placement, "placement")
    discs = [(r["x"], r["y"], CLEAR) for r in _table(spark, a.teleporters, "monuments").select("x", "y").collect()]  # a monument list is small by design
    points = rows.select(F.col("row_idx").alias("id"), "x", "y", (F.col("book_scale") * HALF_BOOK).alias("r"))
    relaxed = stored(topology.relax(points, a.rounds, discs), "relaxed")
    moved = topology.settled(relaxed).select("id", *(F.col(c).alias(f"new_{c}") for c in ("x", "y", "radius", "angle")))
    both = rows.join(moved, rows["row_idx"] == moved["id"])
    told = topology.move_stats(relaxed).first()
    print("relaxed: median move {:.2f}, largest {:.1f}, {} nudged; {} pairs still too near".format(told["mid"] or 0.0, told["most"] or 0.0, told["nudged"], topology.residual(relaxed).first()["pairs"]))
    _put(both.select(*(F.col(f"new_{c}").alias(c) if c in ("x", "y", "radius", "angle") else F.col(c) for c in rows.columns)), a.out)


def heightmap(spark: SparkSession, a: argparse.Namespace) -> None:
    knobs = terrain.Ground(**json.loads(a.ground))
    points = optional(spark, a.books, "x double, y double")
    if a.crop_size:
        grid, size = terrain.window(spark, a.crop_x, a.crop_z, a.crop_size, a.res, knobs), a.crop_size
        binaries.write_raster(a.out, H=grid, world_size=size)
        return
    rows = rasters.heights(points, a.res, ground=knobs).toPandas()  # one raster, of the caller's size, into one file
    grids = {name: np.empty((a.res, a.res)) for name in ("height", "density", "envelope")}
    for name, grid in grids.items():
        grid[rows.i, rows.j] = rows[name]
    binaries.write_raster(a.out, H=grids["height"], density=grids["density"], envelope=grids["envelope"], world_size=terrain.WORLD)


def mesh(spark: SparkSession, a: argparse.Namespace) -> None:
    data = binaries.read_raster(a.heightmap)
    vertices, faces = terrain.grid_mesh(data["H"], float(data["world_size"]), a.stride, a.clip_radius)
    binaries.write_soup(terrain.soup(vertices, faces), a.out)


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = layouts.with_xy(_table(spark, a.rows, "layout"))
    _put(stats.range_histogram(rows.select("x", "y"), a.bins), a.out)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillmap")
    stages = out.add_subparsers(dest="stage", required=True)

    def stage(name: str, run, *flags: str, **more) -> None:
        p = stages.add_parser(name)
        p.set_defaults(run=run)
        for flag in flags:
            p.add_argument(f"--{flag}", required=True, **({"dest": "rows"} if flag == "in" else {}))
        for flag, value in more.items():
            name = "--" + flag.replace("_", "-")
            if value is False:
                p.add_argument(name, action="store_true")
            else:
                p.add_argument(name, type=value if isinstance(value, type) else type(value), default=None if isinstance(value, type) else value)

    stage("figures", figures, "dump", "out", limit=int)
    stage("prefilter", prefilter, "in", "out", death_year_max=2000, keep_missing_description=False)
    stage("articles", read_articles, "in", "dump", "out", limit=int)
    stage("cut", cut, "in", "out", min_article_words=100)
    stage("places", places, "in", "dump", "out", limit=int)
    stage("place", place, "figures", "places", "gazetteer", "out", seed=20260529)
    stage("monuments", monuments, "anchors", "placement", "places", "out")
    stage("relax", relax, "placement", "teleporters", "out", rounds=30)
    stage("heightmap", heightmap, "books", "out", res=2048, ground="{}", crop_size=float, crop_x=0.0, crop_z=0.0)
    stage("mesh", mesh, "heightmap", "out", stride=1, clip_radius=float)
    stage("inspect", inspect, "in", "out", bins=800)
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"quillmap {a.stage}").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
