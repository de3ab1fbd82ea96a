"""Consecutive numbers without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.shared import materialize


def with_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order of a unique column: a range sort, then an offset per partition."""
    ordered = df.sort(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = materialize(ordered, "indexed")
    counts = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    parts = sorted(counts)
    if not parts:
        return df.withColumn(name, F.lit(0).cast("int")).select(name, *df.columns)
    starts = dict(zip(parts, accumulate([0, *(counts[p] for p in parts[:-1])]), strict=True))
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    return ordered.join(F.broadcast(offsets), "_part").select((F.col("_start") + F.col("_at")).cast("int").alias(name), *df.columns)
