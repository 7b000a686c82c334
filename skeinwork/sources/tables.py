"""Reading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table for work that is heavy by row: one that is read by fewer tasks than there are cores is dealt out first.

    That is so for small files only; a table of many splits is read as it is, without a shuffle.
    """
    rows, cores = read(spark, sf_dir, table), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
