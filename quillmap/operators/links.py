"""Articles and their links: redirects, ordered distinct targets, left joins by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_skip_namespace, normalize_title


def attach_articles(figures: DataFrame, articles: DataFrame) -> DataFrame:
    """figures with their article's columns by title; of repeated articles that of the largest article_idx; no article leaves nulls and an empty link list."""
    cols = [c for c in articles.columns if c not in ("title", "article_idx")]
    one = articles.groupBy(F.col("title").alias("a_title")).agg(F.max_by(F.struct(*cols), "article_idx").alias("a"))
    rows = figures.join(one, figures["title"] == one["a_title"], "left")
    return rows.select(*figures.columns, *(F.coalesce(F.col(f"a.{c}"), F.array().cast("array<string>")).alias(c) if c == "links" else F.col(f"a.{c}").alias(c) for c in cols))


def resolve(pages: DataFrame, redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """(page_id, qids): pages(page_id, links) to ids by one redirect hop(source, target) and titles(title, qid, row_idx); first occurrences in order, unresolved ones dropped, the last row of a repeated title wins.

    A link is normalized once: through a list of one, as filters and join keys would else each repeat it.
    """
    one = titles.groupBy("title").agg(F.max_by("qid", "row_idx").alias("qid"))
    flat = pages.select("page_id", F.posexplode("links").alias("pos", "raw")).select("page_id", "pos", F.explode(F.array(normalize_title(F.col("raw")))).alias("link")).where((F.col("link") != "") & ~is_skip_namespace(F.col("link")))
    hop = redirects.groupBy("source").agg(F.max("target").alias("target"))
    hit = flat.join(hop, flat["link"] == hop["source"], "left").withColumn("to", F.coalesce("target", "link")).join(one, F.col("to") == one["title"])
    first = hit.groupBy("page_id", "qid").agg(F.min("pos").alias("pos"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda s: s["qid"]).alias("qids"))
