"""Distances between samples: all pairs, neighbourhoods, pairs within a distance, and legacy metrics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.functions.bits import MAX_WORDS, differing, n_words, pack
from presq.operators.wide import every_pair, near_pairs

METRICS = ("hamming", "jaccard", "absolute", "euclidean", "hamming_fraction")
#: Most rows of a block of the all-pairs plan, and tasks that a plan of few rows is spread over for each core.
BLOCK_ROWS = 2_000
TASKS_A_CORE = 2
#: Columns up to which one sample's alleles, no more than these, are broadcast.
OWN_CELLS = 200_000


def _busy(frame, n: int) -> int:
    """Blocks so that pairs of blocks keep all cores busy: half a pair for two blocks."""
    cores = frame.spark.sparkContext.defaultParallelism
    return int((2 * TASKS_A_CORE * cores) ** 0.5) + 1 if n > 200 else 1


def _blocks(frame, n: int) -> int:
    """Blocks so that rows fit in one, and so that pairs of blocks keep all cores busy."""
    return max(_busy(frame, n), -(-n // BLOCK_ROWS))


def block_pairs(rows: DataFrame, blocks: int, band: str | None = None) -> DataFrame:
    """Pairs x.row_idx < y.row_idx of rows, met in blocks: an equi-join of block pairs, never a nested-loop join.

    Each two blocks i <= j meet once; rows of two blocks meet in either order of their numbers. With a band column only
    rows of equal or neighbouring bands meet.
    """
    r = rows.withColumn("_b", F.pmod(F.xxhash64("row_idx"), F.lit(blocks)).cast("int"))
    left = r.withColumn("_j", F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1)))).withColumn("_i", F.col("_b"))
    right = r.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b")))).withColumn("_j", F.col("_b"))
    number = lambda df: df.withColumn("_k", F.col("_i") * blocks + F.col("_j"))
    left, right, on = number(left), number(right), ["_k"]
    if band is not None:
        left = left.withColumn("_band", F.explode(F.array(F.col(band) - 1, F.col(band), F.col(band) + 1)))
        right, on = right.withColumn("_band", F.col(band)), ["_k", "_band"]
    else:
        # few rows make many pairs: a partition for each pair of blocks, which adaptive execution leaves alone
        parts = blocks * (blocks + 1) // 2
        left, right = (x.repartition(parts, "_k").hint("shuffle_hash") for x in (left, right))
    keys = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    within = (F.col("x._i") != F.col("x._j")) | (F.col("x.row_idx") < F.col("y.row_idx"))
    met = left.alias("x").join(right.alias("y"), [*keys, within])
    return met


def _ordered(first: str, second: str, name: str):
    """Columns name_a and name_b of the side with the lesser row number and of the other."""
    lower = F.col("x.row_idx") < F.col("y.row_idx")
    return [F.when(lower, F.col(f"x.{first}")).otherwise(F.col(f"y.{first}")).alias(f"{name}_a"), F.when(lower, F.col(f"y.{second}")).otherwise(F.col(f"x.{second}")).alias(f"{name}_b")]


def _masses(words: int):
    return reduce(add, [F.bit_count(f"w{k}") for k in range(words)]).cast("int")


def hamming_pairs(frame, guids: list[str] | None = None) -> DataFrame:
    """(guid_a, guid_b, mass_a, mass_b, distance) of every pair in matrix order."""
    words = n_words(frame.width())
    labels = frame.labels if guids is None else frame.labels.where(F.col("guid").isin(guids))
    n = frame.n_guids() if guids is None else len(set(guids))
    if words > MAX_WORDS:
        return every_pair(frame, labels, _busy(frame, n))
    indexed = frame.indexed() if guids is None else frame.indexed().join(F.broadcast(labels.select("row_idx")), "row_idx", "left_semi")
    rows = pack(indexed, labels, words)
    rows = rows.withColumn("mass", _masses(words))
    return block_pairs(rows, _blocks(frame, n)).select(*_ordered("guid", "guid", "guid"), *_ordered("mass", "mass", "mass"), differing("x", "y", words).alias("distance"))


def _common():
    return (F.col("mass_a") + F.col("mass_b") - F.col("distance")) / F.lit(2)


def pairwise(frame, metric: str = "hamming", guids=None) -> DataFrame:
    """(guid_a, guid_b, distance) of every pair, once."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    pairs = hamming_pairs(frame, None if guids is None else frame.check_guids(guids))
    if metric in ("hamming", "absolute"):
        d = F.col("distance")
    elif metric == "euclidean":
        d = F.sqrt(F.col("distance").cast("double"))
    elif metric == "hamming_fraction":
        d = F.col("distance").cast("double") / F.lit(float(max(1, frame.n_alleles())))
    else:
        union = F.col("mass_a") + F.col("mass_b") - _common()
        d = F.when(union == 0, F.lit(0.0)).otherwise(1 - _common() / union)
    return pairs.select("guid_a", "guid_b", d.alias("distance"))


def square(pairs: DataFrame, guids: DataFrame) -> DataFrame:
    """The condensed pairs, their mirror and the zero diagonal."""
    kind = pairs.schema["distance"].dataType
    mirror = pairs.select(F.col("guid_b").alias("guid_a"), F.col("guid_a").alias("guid_b"), "distance")
    diagonal = guids.select(F.col("guid").alias("guid_a"), F.col("guid").alias("guid_b"), F.lit(0).cast(kind).alias("distance"))
    return pairs.unionByName(mirror).unionByName(diagonal)


def condensed(squared: DataFrame, guids: DataFrame) -> DataFrame:
    """The upper triangle of a square matrix in matrix order."""
    a = guids.select(F.col("guid").alias("guid_a"), F.col("row_idx").alias("ra"))
    b = guids.select(F.col("guid").alias("guid_b"), F.col("row_idx").alias("rb"))
    return squared.join(a, "guid_a").join(b, "guid_b").where("ra < rb").select("guid_a", "guid_b", "distance")


def neighbourhood(frame, guid: str, n: int, include_self: bool = False, order_by: str | None = None) -> DataFrame:
    """(guid, distance) of the samples within n of guid, bounds included; the sample itself only if asked for.

    One pass over the cells counts each sample's alleles and those in common; order_by is guid, distance or none.
    """
    if n < 0:
        raise ValueError("the distance isn't negative")
    if order_by not in (None, "guid", "distance"):
        raise ValueError("order_by is guid or distance")
    frame.check_guids([guid])
    own = frame.presence.where(F.col("guid") == guid).select("allele", F.lit(1).alias("own"))
    counted = frame.presence.join(F.broadcast(own) if frame.width() <= OWN_CELLS else own, "allele", "left")
    counted = counted.groupBy("guid").agg(F.count("*").alias("mass"), F.count("own").alias("c"))
    mass = own.agg(F.count("*").alias("qm"))
    zero = F.lit(0).cast("long")
    out = frame.labels.select("guid").join(counted, "guid", "left").crossJoin(F.broadcast(mass))
    out = out.select("guid", (F.coalesce("mass", zero) + F.col("qm") - 2 * F.coalesce("c", zero)).cast("int").alias("distance"))
    out = out.where((F.col("distance") <= n) & (F.lit(include_self) | (F.col("guid") != guid)))
    return out if order_by is None else out.orderBy(order_by, "guid")


def below(pairs: DataFrame, guid: str, d: float, strict: bool = True) -> DataFrame:
    """(guid, distance) of the row of guid in condensed or square pairs: distances less than d, or at most d; not itself."""
    at = F.col("distance") < d if strict else F.col("distance") <= d
    a = pairs.where((F.col("guid_a") == guid) & at).select(F.col("guid_b").alias("guid"), "distance")
    b = pairs.where((F.col("guid_b") == guid) & at).select(F.col("guid_a").alias("guid"), "distance")
    return a.union(b).where(F.col("guid") != guid).distinct()


def pairs_within(frame, n: int) -> DataFrame:
    """(guid_a, guid_b, distance) of the pairs within n. Masses of such pairs differ by n at most: a band join."""
    if n < 0:
        raise ValueError("the distance isn't negative")
    words = n_words(frame.width())
    if words > MAX_WORDS:
        return near_pairs(frame, n, _busy(frame, frame.n_guids()))
    rows = pack(frame.indexed(), frame.labels, words).withColumn("mass", _masses(words))
    rows = rows.withColumn("band", F.floor(F.col("mass") / (n + 1)).cast("int"))
    pairs = block_pairs(rows, _blocks(frame, frame.n_guids()), "band").where(F.abs(F.col("x.mass") - F.col("y.mass")) <= n)
    return pairs.select(*_ordered("guid", "guid", "guid"), differing("x", "y", words).alias("distance")).where(F.col("distance") <= n)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(matches, mismatches) between two maps (guid, distance); a guid that one side lacks is a mismatch."""
    both = a.select("guid", F.col("distance").alias("da")).join(b.select("guid", F.col("distance").alias("db")), "guid", "full")
    same = F.coalesce(F.col("da") == F.col("db"), F.lit(False))
    return both.agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("mismatches"))
