"""Phrases in texts by a hash join of token grams, for tables of phrases of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of word characters, and every other character by itself; a phrase on word boundaries is a run of these.
TOKEN = r"(?U)\w+|(?s:\W)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def phrase_table(phrases: DataFrame) -> DataFrame:
    """(phrase, skip, size) of phrases(phrase, skip), in lower case, once each, skipped if any row of it is; those that do not begin and end with a word character cannot stand on word boundaries and go."""
    held = phrases.select(F.lower("phrase").alias("phrase"), F.coalesce("skip", F.lit(False)).alias("skip")).where(F.col("phrase").rlike(r"(?U)^\w(?s:.*\w)?$"))
    return held.groupBy("phrase").agg(F.max("skip").alias("skip")).withColumn("size", F.size(tokens(F.col("phrase"))))


def phrases_in(rows: DataFrame, phrases: DataFrame, text: str = "text", ident: str = "id") -> DataFrame:
    """(ident, phrases): for each row of rows(ident, text) that names any, the phrases on word boundaries, the longest at each place, from left to right and without overlap.

    Phrases with `skip` are found like others, and take their place, but are not told.
    Texts become runs of tokens as long as the longest phrase; those whose first token
    begins a phrase become grams of just the lengths that phrases have, and an equi-join
    finds the phrases, so the work of a text grows with its length and not with their number. Idents are unique; null texts name nothing; texts are read
    whole.
    """
    table = phrase_table(phrases)
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # of tokens in a phrase
    if not sizes:
        return rows.select(ident, F.array().cast("array<string>").alias("phrases")).limit(0)
    words = rows.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), tokens(F.col(text)).alias("t"))
    ahead = [F.slice("t", i + 1, F.greatest(F.size("t") - i, F.lit(0))).alias(f"w{i}") for i in range(sizes[-1])]
    runs = words.select("ident", F.posexplode(F.arrays_zip(*ahead)).alias("at", "w")).select("ident", "at", "w.*")  # a row holds as many tokens as a phrase, not its text
    begins = table.select(F.element_at(tokens(F.col("phrase")), 1).alias("w0")).distinct()
    runs = runs.join(begins, "w0", "left_semi")
    gram = lambda n: F.struct(F.lit(n).alias("n"), F.concat(*(f"w{i}" for i in range(n))).alias("gram"))
    grams = runs.select("ident", "at", F.explode(F.array(*map(gram, sizes))).alias("g")).select("ident", "at", "g.*").where(F.col("gram").isNotNull())  # null beyond the text's end
    met = grams.join(table.select("phrase", "skip", "size"), (F.col("gram") == F.col("phrase")) & (F.col("n") == F.col("size")))
    hits = met.groupBy("ident").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "phrase", "skip"))).alias("hits"))  # of one text
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("told"))
    step = lambda a, h: F.when(h["at"] < a["next"], a).otherwise(F.struct((h["at"] - h["less"]).alias("next"), F.when(h["skip"], a["told"]).otherwise(F.concat(a["told"], F.array(h["phrase"]))).alias("told")))
    out = hits.select(F.col("ident").alias(ident), F.aggregate("hits", start, step)["told"].alias("phrases"))
    return out.where(F.size("phrases") > 0)
