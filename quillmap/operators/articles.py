"""The cut by article length, and leads made ready for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quality_cut(figures: DataFrame, min_article_words: int = 100) -> DataFrame:
    """Figures whose article has `min_article_words` words at least, with cleaned leads and their word and sentence counts.

    No article, no row; a figure without a lead keeps nulls in its three lead columns.
    """
    kept = figures.where(F.coalesce(F.col("article_word_count") >= min_article_words, F.lit(False)))
    rows = kept.withColumn("lead_text", T.clean_lead(F.col("lead_text")))
    return rows.withColumns({"lead_word_count": T.word_count(F.col("lead_text")), "lead_sentence_count": T.sentence_count(F.col("lead_text"))})
