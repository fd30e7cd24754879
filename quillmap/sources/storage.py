"""Tables that stages leave to each other in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a stage leaves them to the next: a Parquet table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored table that a later one, stored too, has taken the place of."""
    removed(df.sparkSession, df.stored_at)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that stages left and that all of its readers have stored from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def required(spark: SparkSession, path: str, what: str) -> str:
    """The path, or an error that names the missing input; any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of the schema where it is missing."""
    try:
        return spark.read.parquet(required(spark, path, "table"))
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
