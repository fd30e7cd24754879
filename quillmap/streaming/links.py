"""Links and redirects as a stream that joins itself: a redirect counts wherever in the stream it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_skip_namespace, normalize_title
from ..sources.dumps import PAGE
from ..sources.wikitext import parse_links

#: A popular title's links are dealt to so many keys; a redirect goes to all of them.
SALTS = 8
TOLD = "link string, page string, pos int, redirect string"
RESOLVED = "page string, pos int, target string, turn int"
#: State on disk, with a bound on the memory of all of an executor's stores together.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def pages_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """(title, redirect, text) of articles in the XML files that come into a folder, at most `files` a batch."""
    reader = spark.readStream.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE)
    p = (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)
    rows = p.where("ns = 0 AND title IS NOT NULL").select("title", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))
    return rows.where("redirect IS NOT NULL OR text IS NOT NULL")


def told(pages: DataFrame) -> DataFrame:
    """TOLD of pages(title, redirect, text), a stream or a table: each link of a page, and each redirect as a link without a page."""
    rows = parse_links(pages)
    hop = F.array(F.struct(F.col("title").alias("link"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("int").alias("pos"), "redirect"))
    links = F.transform("links", lambda raw, i: F.struct(normalize_title(raw).alias("link"), F.col("title").alias("page"), i.cast("int").alias("pos"), F.lit(None).cast("string").alias("redirect")))
    every = rows.select(F.inline(F.when(F.col("redirect").isNotNull(), hop).otherwise(links)))
    return every.where(F.col("redirect").isNotNull() | ((F.col("link") != "") & ~is_skip_namespace(F.col("link"))))


def resolved(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(page, pos, target, turn) of `told` rows, a stream or a table: every link as it stands, turn 0, and again, turn 1, for each redirect of its target, whichever comes first.

    The state is that of a join of the stream with itself: links wait for redirects and
    redirects for links. Of several redirects the greatest target is the last word.
    """
    links = rows.where("redirect IS NULL").select("link", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int").alias("salt"), "page", "pos")
    hops = rows.where("redirect IS NOT NULL").select(F.col("link").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"), "redirect")
    met = links.join(hops, (F.col("link") == F.col("source")) & (F.col("salt") == F.col("part")))
    return links.select("page", "pos", F.col("link").alias("target"), F.lit(0).alias("turn")).union(met.select("page", "pos", "redirect", F.lit(1)))


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int | None = None) -> None:
    """Add what is new in a folder of XML files to the table `out` and stop; a later call, in any session, goes on from the checkpoint.

    Two streams: pages are parsed once into the checkpoint's table of links and redirects, which the second reads for both sides of its join.
    """
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    at = checkpoint.rstrip("/")
    _run(told(pages_stream(spark, folder, files)), f"{at}/told", f"{at}/parsing")
    _run(resolved(spark.readStream.schema(TOLD).parquet(f"{at}/told")), out, f"{at}/joining")


def _run(rows: DataFrame, out: str, checkpoint: str) -> None:
    rows.writeStream.format("parquet").option("compression", "zstd").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outgoing(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, qids): the last word on each link of links(page, pos, target, turn), by titles(title, qid, row_idx); first occurrences in order, unresolved ones dropped."""
    last = links.groupBy("page", "pos").agg(F.max_by("target", F.struct("turn", "target")).alias("to"))
    one = titles.groupBy("title").agg(F.max_by("qid", "row_idx").alias("qid"))
    hit = last.join(one, F.col("to") == F.col("title"))
    first = hit.groupBy("page", "qid").agg(F.min("pos").alias("pos"))
    return first.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda s: s["qid"]).alias("qids"))
