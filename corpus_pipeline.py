"""A training corpus from raw documents: reject toxic texts, keep one of each group of near copies, drop leaked benchmark items, mix sources, write token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import common, decontaminate, mixing, near_dedup, queries, token_output, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7; null and empty texts have no match and stay, repeated rows go together."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every class of near copies; rows of null id and texts without a word stay."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; null and empty texts stay, repeated rows go together."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks, in training order; texts without a word, null ones too, once, and each row by itself."""
    return mixing.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows in the training order that the mix stored, and what reading them back gives for each; a null text is its end id alone."""
    return token_output.export(docs, queries.tokenizer(), common.stored_order(docs))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("tokens", write_tokens)]
#: Models, classes of copies and token ids are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
