"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.functions.text import norm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(presence: DataFrame) -> DataFrame:
    """Presence rows that hold a cell, labels in identifier form; repeated cells are kept."""
    p = presence.where(F.col("guid").isNotNull() & F.col("allele").isNotNull())
    return p.select(norm("guid").alias("guid"), norm("allele").alias("allele"))
