"""Tables written to the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A path in the folder that driver and executors share, not used before; in local mode, where none is
    set, in one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/market-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
