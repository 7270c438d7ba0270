"""Small Spark helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tabkit-checkpoints")
        if spark.sparkContext.master.startswith("local"):
            return folder
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def _table(spark: SparkSession) -> str:
    """A new path in this application's own part of the shared folder, which goes when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tabkit-{spark.sparkContext.applicationId}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)  # only what exists is marked for deletion
    store.deleteOnExit(folder)
    return f"{folder.toString()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = _table(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabkit_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tabkit_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: A key that holds one part in so many of a table's rows is hot; no more keys than this can be.
HOT = 1000


def hot_keys(df: DataFrame, key: str, rows: int) -> list[int]:
    """The keys (of type long) that hold a thousandth of ``rows`` or more."""
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= max(rows / HOT, 100)).select(key).collect() if r[0] is not None]


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list[int] | None = None) -> DataFrame:
    """Inner join on a key that is unique in ``right``; rows of hot keys (at most ``HOT``) meet a broadcast row and are not moved."""
    hot = hot_keys(left, key, left.count()) if hot is None else hot
    if not hot:
        return left.join(right, key)
    few = left.sparkSession.createDataFrame([(k,) for k in hot], f"{key} long")
    some = right.join(F.broadcast(few), key)
    return left.join(F.broadcast(few), key, "left_anti").join(right, key).unionByName(left.join(F.broadcast(some), key))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, where the session leaves Spark's default: whole texts make large rows.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns and their names do not matter."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def plain_names(docs: DataFrame, *known: str) -> DataFrame:
    """The documents under names that clash with no helper's: all but doc_id, text and the known ones by their place."""
    return docs.toDF(*(c if c in ("doc_id", "text", *known) else f"__c{i}" for i, c in enumerate(docs.columns)))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_training(doc_id: str = "doc_id") -> F.Column:
    """Rows that models may learn from: crc32 of the id's digits, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0
