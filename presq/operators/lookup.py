"""Point access, signatures, name matching and subsets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access(frame, coords) -> DataFrame:
    """(pos, row_idx, col_idx, value) of coordinates, given as pairs or as a frame of these columns; order and repeats stay."""
    spark = frame.spark
    small = not isinstance(coords, DataFrame)
    if small:
        rows = [(i, int(r), int(c)) for i, (r, c) in enumerate(coords)]
        coords = spark.createDataFrame(rows, "pos long, row_idx long, col_idx long")
    ends = coords.agg(F.min("row_idx"), F.max("row_idx"), F.min("col_idx"), F.max("col_idx")).first()
    if ends[0] is not None and (min(ends[0], ends[2]) < 0 or ends[1] >= frame.n_guids() or ends[3] >= frame.n_alleles()):
        raise IndexError("coordinates out of range")
    # labels of the asked places first: only cells of asked rows are met
    cells = frame.presence.join(F.broadcast(frame.labels.join(coords.select("row_idx").distinct(), "row_idx", "left_semi")) if small else frame.labels, "guid")
    cells = cells.join(frame.alleles, "allele").select("row_idx", "col_idx", F.lit(1).alias("value"))
    return coords.join(cells, ["row_idx", "col_idx"], "left").select("pos", "row_idx", "col_idx", F.coalesce("value", F.lit(0)).cast("int").alias("value"))


def signature(frame, row_idx: int) -> DataFrame:
    """(col_idx) of a row; none for a row that doesn't exist."""
    return frame.indexed().where(F.col("row_idx") == row_idx).select("col_idx")


def gather(frame, row_indices) -> DataFrame:
    """(col_idx) of several rows as a bag: a row given twice comes twice."""
    rows = frame.spark.createDataFrame([(int(i),) for i in row_indices], "row_idx int")
    return F.broadcast(rows).join(frame.indexed(), "row_idx").select("col_idx")


def match_names(frame, expression: str) -> DataFrame:
    """(allele) whose name begins with a match of the expression: * stands for any text, the rest is a regular expression."""
    if not isinstance(expression, str):
        raise ValueError("the expression is a string")
    pattern = expression.replace("*", ".*")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {expression}") from e
    # what Python writes differently
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace("\\Z", "\\z")
    return frame.alleles.where(F.col("allele").rlike("(?d)^(?:" + pattern + ")")).select("allele")


def coordinates(frame, alleles=None, guids=None) -> DataFrame:
    """(row_idx, col_idx) of every combination, by allele first; None stands for all, unknown labels are an error."""
    g, a = frame.guids.select("row_idx", "guid"), frame.alleles.select("col_idx", "allele")
    if guids is not None:
        g = g.where(F.col("guid").isin(frame.check_guids(guids)))
    if alleles is not None:
        a = a.where(F.col("allele").isin(frame.check_alleles(alleles)))
    return g.crossJoin(F.broadcast(a) if alleles is not None else a).select("row_idx", "col_idx")


def encode(frame, guid: str | None = None, allele: str | None = None) -> int:
    """Position of a label; an unknown one is an error."""
    dim, name, idx, value = (frame.guids, "guid", "row_idx", guid) if guid is not None else (frame.alleles, "allele", "col_idx", allele)
    found = dim.where(F.col(name) == value).agg(F.min(idx)).first()[0]
    if found is None:
        raise ValueError(f"unknown {name}: {value}")
    return found


def decode(frame, row_idx: int | None = None, col_idx: int | None = None) -> str:
    """Label at a position; one out of range is an error."""
    dim, name, idx, value = (frame.guids, "guid", "row_idx", row_idx) if row_idx is not None else (frame.alleles, "allele", "col_idx", col_idx)
    found = dim.where(F.col(idx) == value).select(name).first()
    if found is None:
        raise IndexError(f"{idx} {value} is out of range")
    return found[0]
