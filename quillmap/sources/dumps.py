"""Readers of JSON entity dumps and XML article dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims as C
from ..operators.links import attach_articles, resolve
from .storage import stored
from .wikitext import parse_articles

#: What a dump writes as [] where a map without entries would stand; inside a string its quotes would be escaped.
EMPTY = r'"(claims|labels|descriptions|sitelinks|aliases)":\s*\[\]'
PAGE = "title string, ns int, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each entity of a JSON array written one to a line; bz2 files are split by Hadoop. Brackets, blanks and trailing commas go; empty maps that a dump writes as lists become maps."""
    lines = spark.read.text(path).select(F.trim(F.rtrim("value", F.lit(", \t\r\f\v"))).alias("value")).where(~F.col("value").isin("", "[", "]"))
    return lines.select(F.when(F.contains("value", F.lit("[]")), F.regexp_replace("value", EMPTY, '"$1":{}')).otherwise(F.col("value")).alias("value"))


def entities(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(e, c): parsed entities and their ranked statements. A malformed line fails the job, or is skipped if not strict.

    A filter would be moved below the parser, and then parses a line again for each column
    it names; so both go through a list of one, which filters stay above.
    """
    value = F.when(~F.col("value").isin("", "[", "]"), F.col("value"))  # filters may be moved past the parser
    e = lines.select(F.explode(F.array(F.from_json(value, C.ENTITY, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))).alias("e"))
    return e.where("e.id IS NOT NULL").select("e", F.explode(F.array(C.ranked(F.col("e.claims")))).alias("c"))


def figures(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The fifteen figure columns of every human with a death year and an article; `limit` stops after so many entities."""
    lines = entity_lines(spark, path)
    e = entities(lines.limit(limit) if limit else lines)
    return e.where(C.is_figure(F.col("e"), F.col("c"))).select(*(c.alias(k) for k, c in C.figure_row(F.col("e"), F.col("c")).items()))


def prefilter(rows: DataFrame, death_year_max: int = 2000, keep_missing_description: bool = False) -> DataFrame:
    kept = rows.where(F.col("death_year") < death_year_max)
    return kept if keep_missing_description else kept.where(F.col("description").isNotNull())


def needed_places(rows: DataFrame) -> DataFrame:
    """(need) of the places that figures were born or died in, each once."""
    return rows.select(F.explode(F.array("birth_place_qid", "death_place_qid")).alias("need")).where("need <> ''").distinct()


def places(spark: SparkSession, path: str, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """`limit` stops after so many lines. The seven place columns of the entities that figures were born or died in; the id is cut from the line, so that only needed lines are parsed. Malformed ones are skipped."""
    need = needed_places(rows)
    lines = entity_lines(spark, path)
    lines = (lines.limit(limit) if limit else lines).withColumn("qid", F.regexp_extract("value", r'^\{"type":\s*"item",\s*"id":\s*"(Q[0-9]+)"', 1)).where("qid <> ''")
    e = entities(lines.join(need, lines["qid"] == need["need"], "left_semi"), strict=False)
    return e.select(*(c.alias(k) for k, c in C.place_row(F.col("e"), F.col("c")).items()))


def pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """`limit` stops after so many pages. (title, redirect, text) of articles in the main namespace; a redirect wins over the text, pages without either go."""
    p = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    p = p.limit(limit) if limit else p
    rows = p.where("ns = 0 AND title IS NOT NULL").select("title", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))
    return rows.where("redirect IS NOT NULL OR text IS NOT NULL")


def with_articles(rows: DataFrame, wiki: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Figures with their articles' measures and outgoing ids; redirects anywhere in the dump count.

    One scan of the dump: redirects and the articles of figures are stored, and both
    branches read them from there. `held` gets that table, for the caller to drop.
    """
    titles = rows.select(F.col("title").alias("wanted")).distinct()
    hit = wiki.join(titles, F.coalesce("redirect", "title") == F.col("wanted"), "left_semi")
    wiki = stored(hit, "articles")
    if held is not None:
        held.append(wiki)
    redirects = wiki.where("redirect IS NOT NULL").select(F.col("title").alias("source"), F.col("redirect").alias("target"))
    content = wiki.where("redirect IS NULL").select("title", "text")
    parsed = parse_articles(content).withColumn("article_idx", F.xxhash64("title", "lead_text"))
    out = attach_articles(rows, parsed)
    ids = rows.select("title", "qid", F.monotonically_increasing_id().alias("row_idx"))  # in the order of the figures' table
    qids = resolve(out.select(F.col("qid").alias("page_id"), "links"), redirects, ids)
    joined = out.drop("links").join(qids, F.col("qid") == F.col("page_id"), "left").drop("page_id")
    return joined.withColumn("outgoing_qids", F.coalesce("qids", F.array().cast("array<string>"))).drop("qids")
