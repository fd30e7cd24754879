"""Views that let the driver's tables stand in for figures, places and monuments, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import noise
from ..operators.placement import place, tiers
from ..sources.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as figures: years over 3500, every fifth birth unknown, every eleventh without a place."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    death = (1999 - F.pmod(k * 7919, F.lit(3500))).cast("int")
    return rows.select(
        k.alias("row_idx"), F.concat(F.lit("Q"), k.cast("string")).alias("qid"), F.col("c_name").alias("title"), F.when(k % 5 != 0, death - (k % 80).cast("int")).alias("birth_year"), death.alias("death_year"),
        F.pmod(k * 31, F.lit(120)).cast("int").alias("sitelinks"), F.col("n_name").alias("country"), F.when(k % 11 != 0, F.col("n_nationkey") * 14.4 - 180).alias("lon"), (k % 6000).cast("int").alias("words"), F.year("o_orderdate").alias("order_year"),
    )


FIGURES = """figures AS (SELECT o_orderkey AS row_idx, 'Q' || o_orderkey AS qid, c_name AS title, CASE WHEN o_orderkey % 5 <> 0 THEN (1999 - (o_orderkey * 7919) % 3500 - o_orderkey % 80)::INT END AS birth_year,
  (1999 - (o_orderkey * 7919) % 3500)::INT AS death_year, ((o_orderkey * 31) % 120)::INT AS sitelinks, n_name AS country, CASE WHEN o_orderkey % 11 <> 0 THEN n_nationkey * 14.4::DOUBLE - 180 END AS lon, (o_orderkey % 6000)::INT AS words, year(o_orderdate)::INT AS order_year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sql_uniform(ident: str, salt: str, seed: int = 20260529) -> str:
    return f"((('0x' || substr(md5('{seed}|{salt}|' || {ident}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def sql_normal(ident: str, salt: str) -> str:
    return f"(sqrt(-2 * ln({sql_uniform(ident, salt + 'a')})) * cos(2 * pi() * {sql_uniform(ident, salt + 'b')}))"


def sql_pmod(x: str, m: str) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


SQL_ERA = "(600.0::DOUBLE + 6500 * least(greatest((2000 - death_year) / 2800.0::DOUBLE, 0), 1))"
SQL_BASE = "CASE WHEN birth_year = death_year THEN 1.0 WHEN abs(death_year) % 1000 = 0 AND death_year <> 0 THEN 1.0 WHEN abs(death_year) % 100 = 0 THEN 0.7 WHEN abs(death_year) % 10 = 0 THEN 0.3 ELSE 0.1 END"
SQL_UNCERTAINTY = f"(least(greatest((1000 - death_year) / 1000.0::DOUBLE, 0), 1) * greatest(({SQL_BASE})::DOUBLE, 0.3))"
SQL_RADIUS = f"({SQL_ERA} + 2.5 * {sql_normal('qid', 'radius')} + 350 * {sql_normal('qid', 'scatter')} * {SQL_UNCERTAINTY})"
SQL_SCALE = "(0.8 + 1.8 * (ln(least(greatest(coalesce(words, 100), 100), 5000)) - ln(100)) / (ln(5000) - ln(100)))"
TAU = "(2 * pi())"
PLACED = f"""{FIGURES},
raw AS (SELECT *, {SQL_RADIUS} AS r1, coalesce((lon + 180) / 360 * {TAU}, {sql_uniform('qid', 'residue')} * {TAU}) AS base_angle FROM figures),
mirrored AS (SELECT *, CASE WHEN r1 < 600 THEN 1200 - r1 ELSE r1 END AS radius FROM raw),
turned AS (SELECT *, {sql_pmod(f"base_angle + {sql_normal('qid', 'angle')} * 140 / greatest(radius, 600)", TAU)} AS angle FROM mirrored),
placed AS (SELECT *, radius * cos(angle) AS x, radius * sin(angle) AS y, least(floor(angle / ({TAU} / 24)), 23)::INT AS sec, least(greatest(floor(radius / (SELECT max(radius) FROM turned) * 14), 0), 13)::INT AS ring FROM turned)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with radius, angle, x, y and scale; unlocated ones turn by md5, which DuckDB has too."""
    rows = figures(spark, sf_dir)
    return place(rows.withColumn("turn", noise.uniform(F.col("qid"), "residue")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tiers."""
    return tiers(positions(spark, sf_dir))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored placement, which spatial queries read: filters on positions then reach the scan, not the noise below it."""
    return stored(positions(spark, sf_dir).select("row_idx", "qid", "x", "y", "radius", "angle", "book_scale", "base_angle", "lon", "sitelinks", "title"), "layout")
