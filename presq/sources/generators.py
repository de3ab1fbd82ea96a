"""Seeded synthetic matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.model import AlleleFrame


def _frame(spark: SparkSession, cells: DataFrame, n: int, m: int) -> AlleleFrame:
    name = lambda k, c: F.concat(F.lit(f"{k}_"), F.col(c).cast("string"))
    p = cells.select(name("sample", "row_idx").alias("guid"), name("allele", "col_idx").alias("allele"))
    g = spark.range(n).select(F.col("id").cast("int").alias("row_idx"), name("sample", "id").alias("guid"))
    return AlleleFrame(p, g, spark.range(m).select(F.col("id").cast("int").alias("col_idx"), name("allele", "id").alias("allele")))


def _rows(spark: SparkSession, n: int, make) -> DataFrame:
    """Cells of make(row), row by row, seeded by the row so that partitions don't matter."""

    def run(batches):
        for b in batches:
            for i in b["id"]:
                c = make(int(i))
                yield pd.DataFrame({"row_idx": np.full(len(c), i, "int32"), "col_idx": np.asarray(c, "int32")})

    return spark.range(n).mapInPandas(run, "row_idx int, col_idx int")


def uniform(spark: SparkSession, n: int, m: int, density: float = 0.5, seed: int = 1) -> AlleleFrame:
    """Independent cells."""
    return _frame(spark, _rows(spark, n, lambda i: np.flatnonzero(np.random.default_rng([seed, i]).random(m) < density)), n, m)


def sparse(spark: SparkSession, n: int, m: int, sparsity: float = 0.05, seed: int = 1) -> AlleleFrame:
    """Exactly int(sparsity * m) ones a row."""
    return _frame(spark, _rows(spark, n, lambda i: np.random.default_rng([seed, i]).choice(m, int(sparsity * m), replace=False)), n, m)


def clustered(spark: SparkSession, n: int, m: int, sparsity: float = 0.01, n_clusters: int = 10, spread: float = 0.001, seed: int = 1) -> AlleleFrame:
    """Rows are centroids with int(spread * m) cells flipped; rows beyond whole clusters stay empty."""
    size = n // n_clusters

    def make(i: int):
        k = i // size if size else n_clusters
        if k >= n_clusters:
            return []
        row = np.random.default_rng([seed, 0, k]).random(m) < sparsity
        row[np.random.default_rng([seed, 1, i]).choice(m, int(spread * m), replace=False)] ^= True
        return np.flatnonzero(row)

    return _frame(spark, _rows(spark, n, make), n, m)


def coordinates(spark: SparkSession, n: int, m: int, k: int, seed: int = 1) -> DataFrame:
    """(pos, row_idx, col_idx): k random coordinates, with repeats."""
    at = lambda top, s: F.floor(F.rand(s) * top).cast("long")
    return spark.range(k).select(F.col("id").alias("pos"), at(n, seed).alias("row_idx"), at(m, seed + 1).alias("col_idx"))
