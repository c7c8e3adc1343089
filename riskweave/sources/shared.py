"""The folder that driver and executors share, for tables written between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all run on one machine (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskweave-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_place(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: it isn't computed again by each of its users, and a lost executor loses none of it."""
    place = new_place(df.sparkSession, tag)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
