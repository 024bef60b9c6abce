"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as its files are split; ``spark.sql.files.*`` of the session decide on the partitions."""
    return spark.read.parquet(path)
