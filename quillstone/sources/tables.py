"""Readers of the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters are pushed down to Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, for work that takes far longer on a row than moving it does: a small file is read by a task or two."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
