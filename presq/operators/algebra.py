"""Allele set algebra: core, accessory and unique alleles, carriers, merges and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_labels(values, what: str) -> list[str]:
    """Labels given as a list, tuple or set, in order and with repeats; anything else, or none at all, is an error."""
    if not isinstance(values, list | tuple | set | frozenset):
        raise ValueError(f"{what} are a list, tuple or set")
    if not values:
        raise ValueError(f"no {what} given")
    return [str(v) for v in values]


def threshold(n: int, missingness: float) -> float:
    """Least count of a core allele: the product of doubles, so 3 of 10 isn't core at a missingness of 0.7."""
    if not 0 <= missingness <= 1:
        raise ValueError("missingness is between 0 and 1")
    return (1 - missingness) * n


def allele_counts(frame, guids: list[str]) -> DataFrame:
    """(allele, count) over a bag of guids: one given twice counts twice."""
    bag = frame.spark.createDataFrame([(g,) for g in guids], "guid string").groupBy("guid").agg(F.count("*").alias("times"))
    return frame.presence.join(F.broadcast(bag), "guid").groupBy("allele").agg(F.sum("times").alias("count"))


def core(frame, guids, missingness: float = 0.0) -> DataFrame:
    """(allele, count) of the alleles that at least (1 - missingness) of the guids carry."""
    given = frame.check_guids(as_labels(guids, "guids"))
    return allele_counts(frame, given).where(F.col("count") >= F.lit(float(threshold(len(given), missingness))))


def accessory(frame, guids, missingness: float = 0.0) -> DataFrame:
    """(allele, count) of the observed alleles that aren't core."""
    given = frame.check_guids(as_labels(guids, "guids"))
    return allele_counts(frame, given).where(F.col("count") < F.lit(float(threshold(len(given), missingness))))


def unique(frame, guids) -> DataFrame:
    """(allele): those that all of guids carry and no other sample does; with all samples given, the core."""
    given = sorted(set(frame.check_guids(as_labels(guids, "guids"))))
    inside = F.col("guid").isin(given)
    both = frame.presence.groupBy("allele").agg(F.count_if(inside).alias("in"), F.count_if(~inside).alias("out"))
    return both.where((F.col("in") == len(given)) & (F.col("out") == 0)).select("allele")


def carried_by_all(frame) -> DataFrame:
    """(allele): those that every sample carries."""
    return frame.presence.groupBy("allele").agg(F.count("*").alias("n")).where(F.col("n") == frame.n_guids()).select("allele")


def carriers(frame, alleles, on_unknown: str = "error") -> DataFrame:
    """(guid): samples that carry every allele given. Unknown alleles are an error, or with ignore are left out;
    with none left every sample is a carrier."""
    asked = sorted(set(as_labels(alleles, "alleles")))
    known = [r.allele for r in frame.alleles.where(F.col("allele").isin(asked)).select("allele").distinct().collect()]
    if on_unknown == "error" and len(known) < len(asked):
        raise ValueError(f"unknown alleles: {sorted(set(asked) - set(known))}")
    if not known:
        return frame.guids.select("guid")
    hit = frame.presence.where(F.col("allele").isin(known)).groupBy("guid").agg(F.count_distinct("allele").alias("n"))
    return hit.where(F.col("n") == len(known)).select("guid")


def symmetric_difference(frame, guid_a: str, guid_b: str) -> DataFrame:
    """(allele): those that exactly one of two samples carries."""
    frame.check_guids([guid_a, guid_b])
    if guid_a == guid_b:
        return frame.presence.select("allele").limit(0)
    own = frame.presence.where(F.col("guid").isin(guid_a, guid_b))
    return own.groupBy("allele").agg(F.count("*").alias("n")).where("n = 1").select("allele")


def union_alleles(frame, guids) -> DataFrame:
    """(allele): those that any of guids carries."""
    given = frame.check_guids(as_labels(guids, "guids"))
    return frame.presence.where(F.col("guid").isin(given)).select("allele").distinct()


def unique_per_sample(frame) -> DataFrame:
    """(guid, total, unique): a sample's alleles, and those that it alone carries."""
    alone = frame.presence.groupBy("allele").agg(F.count("*").alias("n"), F.first("guid").alias("guid")).where("n = 1")
    alone = alone.groupBy("guid").agg(F.count("*").alias("unique"))
    zero = F.lit(0).cast("long")
    return frame.guids.join(alone, "guid", "left").select("guid", F.col("mass").cast("long").alias("total"), F.coalesce("unique", zero).alias("unique"))


def by_contig(frame) -> DataFrame:
    """(contig, alleles): allele names by what stands before their first dot."""
    contig = F.substring_index("allele", ".", 1).alias("contig")
    return frame.alleles.groupBy(contig).agg(F.array_sort(F.collect_list("allele")).alias("alleles"))


def merge(p1: DataFrame, p2: DataFrame, mode: str = "or") -> DataFrame:
    """Outer union of two cell tables: mode or gives (guid, allele), mode sum gives (guid, allele, value)."""
    if mode not in ("or", "sum"):
        raise ValueError("mode is or or sum")
    both = p1.select("guid", "allele").union(p2.select("guid", "allele"))
    return both.distinct() if mode == "or" else both.groupBy("guid", "allele").agg(F.count("*").cast("int").alias("value"))
