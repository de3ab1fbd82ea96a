"""Records as sets of hashed tokens, for the operators on set-valued records."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.shared import materialize

#: Counters of the token frequency sketch, a byte each: one for every four cells of the data, between these bounds.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 26
_BLOCK = 1 << 16


def token_sets(rows: DataFrame, kind: int = 0) -> DataFrame:
    """(id, kind, tokens) of rows(rec, term); repeated rows are combined before the one exchange. Tokens are 64-bit hashes."""
    kept = rows.where(F.col("rec").isNotNull() & F.col("term").isNotNull())
    sets = kept.groupBy(F.col("rec").alias("id")).agg(F.collect_set(F.xxhash64("term")).alias("tokens"))
    return sets.select("id", F.lit(kind).cast("byte").alias("kind"), F.array_sort("tokens").alias("tokens"))


def level(count):
    """A count on the sketch's scale of a byte: 0 for none, 1 for one alone, eight levels to a doubling."""
    count = np.asarray(count, np.float64)
    return np.where(count < 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1))))).astype(np.uint8)


def _block(table: pa.Table) -> pa.Table:
    out = np.zeros(_BLOCK, np.uint8)
    out[table["slot"].to_numpy() % _BLOCK] = level(table["count"].to_numpy())
    return pa.table({"block": table["block"].slice(0, 1), "levels": pa.array([out.tobytes()], pa.binary())})


def sketch(sets: DataFrame, cells: int) -> np.ndarray:
    """Rough frequencies of tokens by hash, for so many cells: it only orders tokens, so its errors change no result.

    The levels are put together in tasks, a block of counters each; MOST_COUNTERS bytes at most reach the driver.
    """
    n = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (cells // 4).bit_length()))
    slot = F.col("t").bitwiseAND(F.lit(n - 1).cast("long")).alias("slot")
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(slot).count().withColumn("block", F.floor(F.col("slot") / _BLOCK))
    out = np.zeros(n, np.uint8)
    for r in counts.groupBy("block").applyInArrow(_block, "block long, levels binary").collect():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(bytes(r.levels), np.uint8)
    return out


def frequency(levels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return levels[tokens & (len(levels) - 1)]


def classes(sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One representative (rep, kind, tokens) of equal sets of one kind, and the members (rep, id) of those that have copies."""
    keyed = sets.select("id", "kind", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(11), "tokens").alias("h2"), F.size("tokens").alias("n"))
    least = keyed.groupBy("h1", "h2", "n", "kind").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = materialize(keyed.join(least, ["h1", "h2", "n", "kind"]).select("rep", "id", "kind"), name)
    copies = members.where(F.col("rep") != F.col("id")).select("id", "kind")
    reps = sets.join(copies, ["id", "kind"], "left_anti").select(F.col("id").alias("rep"), "kind", "tokens")
    return reps, members


def reaches(a, b, threshold: Fraction):
    """Whether the similarity of two token arrays reaches a threshold, in whole numbers."""
    common = F.size(F.array_intersect(a, b))
    return common * (threshold.denominator + threshold.numerator) >= (F.size(a) + F.size(b)) * threshold.numerator


def jaccard(a, b):
    """Similarity of two token arrays without repeats; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))
