"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a temporary folder on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared one; nothing is created yet."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by rounds: each is written once, as a folder of its own, and nothing is written again."""

    def __init__(self, first: DataFrame):
        self.spark, self.path, self.schema, self.n = first.sparkSession, scratch(first.sparkSession), first.schema, 0
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{self.n}")
        self.newest = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.n}")
        self.n += 1

    def known(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{i}" for i in range(self.n)])
