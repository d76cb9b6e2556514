"""Tables between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Parquet tables in the folder that driver and executors share (spark.checkpoint.dir): they cut lineage, and survive the
    loss of executors. Only where the setting is absent, as in local tests, a temporary folder is used."""

    def __init__(self, spark: SparkSession, name: str):
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="larkwing-")
        self.spark, self.root = spark, f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
