"""Monuments: members by name, centroid, seat, era, and a constraint on their spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import century
from ..sources.storage import stored
from .quantiles import quantiles


def members(anchors: DataFrame, figures: DataFrame) -> DataFrame:
    """One row for each name of anchors(label, people): the figure of most sitelinks of that title, the first on ties; qid null if missing."""
    best = figures.groupBy("title").agg(F.max_by(F.struct(*(c for c in figures.columns if c != "title")), F.struct(F.col("sitelinks"), -F.col("row_idx"))).alias("f"))
    names = anchors.select("label", F.posexplode("people").alias("pos", "name"))
    return names.join(best, F.col("name") == F.col("title"), "left").select("label", "pos", "name", "f.*")


def summarize(members: DataFrame) -> DataFrame:
    """A monument for each label, also one without any located member: centroid, seat (most sitelinks, the first on ties), median death year and its century, members, longitude spread (seam ignored).

    Medians are selected, so a label may have any number of members; its lists have as many entries as the label names people.
    """
    members = stored(members, "members")
    here = F.col("qid").isNotNull() & F.col("geo_source").isNotNull()
    only = lambda c: F.when(here, F.col(c))
    best = F.struct(F.col("sitelinks"), -F.col("pos"))
    middle = quantiles(members.where(here), F.col("death_year"), {"mid_year": 0.5}, F.col("label")).withColumnRenamed("group", "of")
    rows = members.groupBy("label").agg(
        F.avg(only("x")).alias("x"), F.avg(only("y")).alias("y"), F.max_by(only("qid"), F.when(here, best)).alias("seat_qid"), F.max_by(only("name"), F.when(here, best)).alias("seat_title"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda m: m["name"]).alias("people"),
        F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("pos", "qid")))), lambda m: m["qid"]).alias("member_qids"),
        F.count_if(here).cast("int").alias("n_members"), F.coalesce(F.max(only("country_lon")) - F.min(only("country_lon")), F.lit(0.0)).alias("lon_spread"),
    )
    return rows.join(middle, F.col("label").eqNullSafe(F.col("of")), "left").drop("of").withColumn("era", century(F.col("mid_year")))


def require(monuments: DataFrame, least: int = 2, spread: float = 40.0) -> DataFrame:
    """The same, or an error that names the labels with too few members or a spread of `spread` degrees or more; a monument list is small by design."""
    bad = monuments.where((F.col("n_members") < least) | (F.col("lon_spread") >= spread)).select("label", "n_members", "lon_spread").limit(100).collect()
    if bad:
        raise ValueError("monuments break the constraint: " + "; ".join(f"{r['label']} ({r['n_members']} members, spread {r['lon_spread']:.1f})" for r in bad))
    return monuments


def country_longitudes(places: DataFrame) -> DataFrame:
    """(country_qid, lon): the mean longitude of a country's places."""
    known = F.col("country_qid").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lon")
    return places.where(known).groupBy("country_qid").agg(F.avg("lon").alias("lon"))


def monuments(anchors: DataFrame, figures: DataFrame, places: DataFrame, least: int = 2, spread: float = 40.0) -> DataFrame:
    """The monument table of anchors(label, people): ten columns, spreads rounded to one place; an error if a monument breaks the constraint."""
    lon = country_longitudes(places).select(F.col("country_qid").alias("of"), F.col("lon").alias("country_lon"))
    found = members(anchors, figures)
    rows = require(summarize(found.join(lon, found["country_qid"] == lon["of"], "left").drop("of")), least, spread)
    return rows.select("label", "x", "y", "seat_qid", "seat_title", "people", "member_qids", "era", "n_members", F.bround("lon_spread", 1).alias("lon_spread"))
