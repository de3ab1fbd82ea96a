"""Samples that arrive as a stream against a fixed matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.model import AlleleFrame


def arriving_neighbours(stream: DataFrame, frame: AlleleFrame, n: int) -> DataFrame:
    """(query, guid, distance) within n of each arriving row of stream(query, alleles: array). Stateless: each row
    meets the matrix's inverted lists within its own micro-batch; use with foreachBatch or on a static frame.

    A sample that shares no allele with an arriving one is within n only if their masses add up to n at most.
    """
    q = stream.select("query", F.array_distinct(F.filter("alleles", lambda x: x.isNotNull())).alias("own"))
    cells = q.select("query", F.size("own").alias("qm"), F.explode("own").alias("allele"))
    shared = cells.join(frame.presence, "allele").groupBy("query", "guid").agg(F.count("*").alias("c"))
    light = q.where(F.size("own") <= n).select("query", F.explode(F.sequence(F.lit(0), F.lit(n) - F.size("own"))).alias("mass"))
    apart = light.join(frame.guids.where(F.col("mass") <= n), "mass").select("query", "guid", F.lit(0).cast("long").alias("c"))
    counts = shared.union(apart).groupBy("query", "guid").agg(F.max("c").alias("c"))
    sized = counts.join(q.select("query", F.size("own").alias("qm")), "query").join(frame.guids, "guid")
    distance = (F.col("qm") + F.col("mass") - 2 * F.col("c")).cast("int")
    return sized.select("query", "guid", distance.alias("distance")).where(F.col("distance") <= n)
