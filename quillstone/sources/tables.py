"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temp views of the named tables; nothing is read yet."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
