"""Where a figure stands: the location ladder, borrowed longitudes, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import noise
from ..functions.text import match_phrase


def anchor(figures: DataFrame, places: DataFrame) -> DataFrame:
    """Longitude and geo_source from the birth place, else the death place, of those with both coordinates; the country from either, by itself."""
    b = places.select(F.col("qid").alias("b_qid"), F.when(F.col("lat").isNotNull(), F.col("lon")).alias("b_lon"), F.col("country_qid").alias("b_country"))
    d = b.select(F.col("b_qid").alias("d_qid"), F.col("b_lon").alias("d_lon"), F.col("b_country").alias("d_country"))
    rows = figures.join(b, figures["birth_place_qid"] == b["b_qid"], "left").join(d, F.col("death_place_qid") == F.col("d_qid"), "left")
    return rows.withColumns(
        {"lon": F.coalesce("b_lon", "d_lon"), "geo_source": F.when(F.col("b_lon").isNotNull(), "birth").when(F.col("d_lon").isNotNull(), "death"), "country_qid": F.coalesce("b_country", "d_country")}
    ).drop("b_qid", "b_lon", "b_country", "d_qid", "d_lon", "d_country")


def pools(anchored: DataFrame, least: int) -> DataFrame:
    """(country_qid, n) of countries with `least` located figures or more."""
    return anchored.where(F.col("lon").isNotNull() & F.col("country_qid").isNotNull()).groupBy("country_qid").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ladder(figures: DataFrame, pool: DataFrame) -> DataFrame:
    """Rungs for figures without a longitude: the first citizenship with a pool, else the region the text names; `citizen` and `region` hold aliased ids."""
    c = pool.select(F.col("country_qid").alias("c_id"))
    g = pool.select(F.col("country_qid").alias("g_id"))
    rows = figures.join(F.broadcast(c), figures["citizen"] == c["c_id"], "left").join(F.broadcast(g), F.col("region") == F.col("g_id"), "left")
    source = F.when(F.col("lon").isNotNull(), F.col("geo_source")).when(F.col("c_id").isNotNull(), "citizenship").when(F.col("g_id").isNotNull(), "gazetteer")
    country = F.when(F.col("lon").isNotNull(), F.col("country_qid")).otherwise(F.coalesce("c_id", "g_id", "country_qid"))
    return rows.withColumns({"geo_source": source, "country_qid": country}).drop("c_id", "g_id")


def borrow(figures: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, lon) for figures(qid, country_qid): the longitude of a fixed pseudo-random located compatriot of pool(qid, country_qid, lon).

    Ranks within a country come from buckets of the id's hash: a running count over the
    buckets, then within each, so that no task holds a country.
    """
    buckets = pool.withColumn("bucket", F.conv(F.substring(F.md5("qid"), 1, 2), 16, 10).cast("int"))
    sizes = buckets.groupBy("country_qid", "bucket").agg(F.count("*").alias("m"))
    w = Window.partitionBy("country_qid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("m").over(w), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("country_qid"))).drop("m")
    ranked = buckets.join(ahead, ["country_qid", "bucket"]).withColumn("at", F.col("ahead") + F.row_number().over(Window.partitionBy("country_qid", "bucket").orderBy("qid")) - 1)
    counts = sizes.groupBy("country_qid").agg(F.sum("m").alias("n"))
    asks = figures.join(counts, "country_qid").withColumn("at", F.floor(noise.uniform(F.col("qid"), "borrow") * F.col("n")).cast("long"))
    return asks.select("qid", "country_qid", "at").join(ranked.select("country_qid", "at", "lon"), ["country_qid", "at"]).select("qid", "country_qid", "lon")


def tiers(placed: DataFrame, floor: int = 80, sectors: int = 24, rings: int = 14) -> DataFrame:
    """landmark_tier: major from `floor` sitelinks on; minor for the best located figure of a cell unless it is major; else ordinary.

    The first row in row_idx order wins ties. The best of a cell is an aggregate with
    partial sums, so crowded cells don't gather in a task.
    """
    most = placed.agg(F.max("radius").alias("rmax"))
    rows = placed.crossJoin(F.broadcast(most)).withColumns({"sec": G.sector(F.col("angle"), sectors), "ring": G.ring(F.col("radius"), F.col("rmax"), rings)}).drop("rmax")
    best = rows.where(F.col("lon").isNotNull()).groupBy("sec", "ring").agg(F.max(F.struct(F.col("sitelinks").alias("s"), (-F.col("row_idx")).alias("i"))).alias("top")).select(F.col("sec").alias("s2"), F.col("ring").alias("r2"), (-F.col("top.i")).alias("best"))
    both = rows.join(F.broadcast(best), (F.col("sec") == F.col("s2")) & (F.col("ring") == F.col("r2")), "left")
    tier = F.when(F.col("sitelinks") >= floor, "major").when(F.coalesce(F.col("best") == F.col("row_idx"), F.lit(False)), "minor").otherwise("ordinary")
    return both.withColumn("landmark_tier", tier).drop("s2", "r2", "best")


def place(figures: DataFrame, seed: int = noise.SEED) -> DataFrame:
    """Radius, angle, x, y and scale of figures(row_idx, qid, birth_year, death_year, lon, sitelinks, words).

    Unknown years count as 2000, unknown sitelinks as 0 and unknown words as 100. A figure
    without a longitude turns by a hash of its id, or by a column `turn` in [0, 1) if there is one.
    """
    q, death = F.col("qid"), F.coalesce("death_year", F.lit(G.NOW))
    turn = F.col("turn") if "turn" in figures.columns else noise.residue(F.when(F.col("lon").isNull(), q))  # located ids stay out of Arrow
    rows = figures.withColumns({"nr": noise.normal(q, "radius", seed), "ns": noise.normal(q, "scatter", seed), "na": noise.normal(q, "angle", seed), "date_uncertainty": G.uncertainty(F.coalesce("birth_year", F.lit(G.NOW)), death), "base_angle": G.base_angle(F.col("lon"), turn), "sitelinks": F.coalesce("sitelinks", F.lit(0))})
    rows = rows.withColumn("radius", G.era_radius(death) + G.JITTER * F.col("nr") + G.SCATTER * F.col("ns") * F.col("date_uncertainty"))
    rows = rows.withColumn("radius", G.reflect(F.col("radius")))
    rows = rows.withColumn("angle", G.wrap(F.col("base_angle") + F.col("na") * G.ARC / F.greatest("radius", F.lit(G.R_INNER))))
    return rows.withColumns({"x": F.col("radius") * F.cos("angle"), "y": F.col("radius") * F.sin("angle"), "book_scale": G.book_scale(F.col("words"))}).drop("nr", "ns", "na", "turn")


def aliased(ident: Column, aliases: dict[str, str]) -> Column:
    """The id that stands for an id; itself where none does."""
    if not aliases:
        return ident
    table = F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, ident), ident)


def candidates(figures: DataFrame, gazetteer: dict) -> DataFrame:
    """figures with `citizen`, the first citizenship, and `region`, the first region that the description names, both aliased."""
    regions = gazetteer["regions"]
    named = match_phrase(F.col("description"), list(regions), gazetteer["ignore"])
    ids = F.create_map(*(F.lit(x) for pair in sorted(regions.items()) for x in pair)) if regions else F.create_map().cast("map<string,string>")
    return figures.withColumns({"citizen": aliased(F.get("citizenships", F.lit(0)), gazetteer["aliases"]), "region": aliased(F.try_element_at(ids, named), gazetteer["aliases"])})


def locate(figures: DataFrame, places: DataFrame, gazetteer: dict) -> DataFrame:
    """The whole ladder: figures with lon, geo_source and country_qid.

    Longitudes come from birth or death places, else from a compatriot of the first
    citizenship or of the region that the description names, if its country has
    `min_pool` located figures; what is left has none.
    """
    known = anchor(figures, places)
    rows = ladder(candidates(known, gazetteer), pools(known, gazetteer["min_pool"])).drop("citizen", "region")
    asks = rows.where(F.col("lon").isNull() & F.col("geo_source").isin("citizenship", "gazetteer")).select("qid", "country_qid")
    lent = borrow(asks, known.where(F.col("lon").isNotNull() & F.col("country_qid").isNotNull()).select("qid", "country_qid", "lon")).select(F.col("qid").alias("lent_qid"), F.col("lon").alias("lent"))
    return rows.join(lent, rows["qid"] == lent["lent_qid"], "left").withColumn("lon", F.coalesce("lon", "lent")).drop("lent_qid", "lent")
