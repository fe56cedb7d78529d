"""Written tables in the folder that the cluster shares, for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its own; any other must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-foilframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else has."""
    return f"{shared_folder(spark)}/foilframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once and read from a table afterwards; plans built on it stay short, and a lost executor takes nothing with it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
