"""Intermediate tables in a folder that all machines share: they cut a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or set as the context's checkpoint folder.

    Where neither is set, a folder of our own serves a local session; on a cluster that is an error, since other
    machines couldn't read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="seqwatch-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def data(df: DataFrame) -> DataFrame:
    """`df` for a join with rows of its own kind: sorted and merged, not broadcast.

    Spark tells the size of a table by that of its files, and sequences are packed so well there that millions of rows
    seem small enough to be gathered on the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{durable_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
