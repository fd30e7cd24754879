"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, of: DataFrame | None = None, tasks: int = 1) -> DataFrame:
    """The same rows, written to the shared folder and read again: a cut in the lineage that outlives executors.

    With `of`, the table from whose size that of df follows, the last step runs in as many
    tasks as its bytes ask for, `tasks` a core at least, so that a small table isn't
    written as a file for each partition of a shuffle.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if of is not None:
        df = df.coalesce(tasks_for(of, tasks))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def tasks_for(df: DataFrame, tasks: int = 1, part_bytes: int = 64 << 20) -> int:
    """Tasks for rows of the size of df, `tasks` a core at least; the session's number of partitions where the size is unknown."""
    spark, size = df.sparkSession, plan_bytes(df)
    return max(tasks * spark.sparkContext.defaultParallelism, -(-size // part_bytes) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions")))


def dropped(*tables: DataFrame) -> None:
    """Delete what `written` stored of these tables, once tables written later have taken their place; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_order(df: DataFrame) -> tuple[Column, ...]:
    """Sort keys that give the rows of a table read from Parquet in the order in which they were written; none for other rows.

    Writers number files by partition, and by chunk within it, and rows by place in the file.
    """
    if not df._jdf.queryExecution().analyzed().metadataOutput().nonEmpty():
        return ()
    name = F.col("_metadata.file_name")
    number = lambda p: F.regexp_extract(name, p, 1).try_cast("int")
    return number(r"^part-(\d+)"), number(r"-c(\d+)"), name, F.col("_metadata.row_index")


def free(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer thinks the rows weigh."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, part_bytes: int = 128 << 20) -> int:
    """Partitions for a shuffle of df: at least the session's number, and more once they would exceed part_bytes; that number alone where the size is unknown."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(least, -(-size // part_bytes)) if size < 1 << 50 else least


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def write_whole(uri: str, name: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a name of this attempt and move it into place, so a lost or repeated task leaves one whole file."""
    store, root = open_fs(uri)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, f"{root}/{name}")
    return size


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def finite(vector: Column) -> Column:
    """Not null, every component finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, y) of labelled rows that may be learned from, about `most` of them at any size of the table.

    Rows are chosen by a hash of the id, so reruns agree. Repeated ids take the mean
    label, 0.5 counting as 1; null ids and null labels are left out.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id").agg(F.avg(label).alias("y")).select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    )
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return rows


_owner: list = ["", lambda: None]


def own(name: str, clear=lambda: None) -> None:
    """To be called as an operator starts in a worker: what another one kept there in its caches goes back to the system."""
    if _owner[0] != name:
        _owner[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _owner[:] = name, clear


class Cache(dict):
    """A dict that fills itself and forgets everything beyond `most` entries, to bound a worker's memory; long words are not kept."""

    LONGEST = 64

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= self.LONGEST:
            self[key] = value
        return value
