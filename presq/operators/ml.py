"""Standardised principal components, k-means of samples and a non-negative factorisation."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizerModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(frame) -> DataFrame:
    """(guid, features): each sample's row as a sparse vector, made in the JVM."""
    m = frame.n_alleles()
    to_vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(m)], "cols", "features", binary=True)
    sets = frame.indexed().groupBy("row_idx").agg(F.collect_set(F.col("col_idx").cast("string")).alias("cols"))
    rows = frame.labels.join(sets, "row_idx", "left").select("guid", F.coalesce("cols", F.array().cast("array<string>")).alias("cols"))
    return to_vector.transform(rows).select("guid", "features")


def principal_components(frame, k: int = 4) -> DataFrame:
    """(guid, components): the first k components of the standardised matrix; signs are arbitrary."""
    data = features(frame)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data).transform(data)
    return PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).select("guid", vector_to_array("pc").alias("components"))


def distance_rows(frame, metric: str = "hamming") -> DataFrame:
    """(guid, features): each sample's row of the square distance matrix, in matrix order; meant for few samples."""
    at = frame.labels.select(F.col("row_idx").alias("at"), F.col("guid").alias("guid_b"))
    rows = frame.square_matrix(metric=metric).join(at, "guid_b").groupBy(F.col("guid_a").alias("guid"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("at", F.col("distance").cast("double").alias("d")))).alias("row"))
    return rows.select("guid", array_to_vector(F.col("row.d")).alias("features"))


def kmeans(frame, k: int, seed: int = 0, on: str = "distances") -> DataFrame:
    """(guid, cluster) of the rows of the distance matrix, or of the cells; labels are arbitrary."""
    if on not in ("distances", "cells"):
        raise ValueError("on is distances or cells")
    data = distance_rows(frame) if on == "distances" else features(frame)
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("guid", F.col("prediction").alias("cluster"))


def admixture(frame, k: int = 4, seed: int = 0, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """(guid, shares) and (allele, source): a non-negative factorisation of the cells by alternating least squares.

    shares are a sample's k weights, made to sum to 1; source is the factor with an allele's greatest weight. It visits
    every cell of the matrix, zeros included, and is meant for narrow ones; factors come in no particular order.
    """
    at = frame.to_dense().join(frame.labels, "guid").join(frame.alleles, "allele")
    ratings = at.select(F.col("row_idx").alias("user"), F.col("col_idx").alias("item"), F.col("value").cast("float").alias("rating"))
    model = ALS(rank=k, maxIter=iterations, nonnegative=True, seed=seed, regParam=0.01).fit(ratings)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    shares = F.transform("features", lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / k)))
    w = model.userFactors.select(F.col("id").alias("row_idx"), shares.alias("shares")).join(frame.labels, "row_idx").select("guid", "shares")
    source = (F.array_position("features", F.array_max("features")) - 1).cast("int")
    return w, model.itemFactors.select(F.col("id").alias("col_idx"), source.alias("source")).join(frame.alleles, "col_idx").select("allele", "source")
