"""Tables that several later steps read, written once where driver and executors both see them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not str(spark.sparkContext.master).startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "pitfolio-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back, so that what made it runs once.

    The files outlive lost executors; the caller's session keeps the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
