"""Frames written once to the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession) -> str:
    """A path in this application's part of the shared folder, which goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tabkit-checkpoints")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tabkit-{spark.sparkContext.applicationId}")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)  # only what exists is marked for deletion
    store.deleteOnExit(where)
    return f"{where.toString()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
