"""Bit-packed rows: 64 alleles in a bigint word."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a side that keep a pair's expression within whole-stage code generation.
MAX_WORDS = 48


def n_words(n_alleles: int) -> int:
    return max(1, -(-n_alleles // 64))


def pack(indexed: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """rows with words w0.. of indexed(row_idx, col_idx); rows without a cell have zero words. One partial aggregate."""
    bit = F.expr("shiftleft(1L, col_idx % 64)")
    aggs = [F.bit_or(F.when(F.floor(F.col("col_idx") / 64) == k, bit)).alias(f"w{k}") for k in range(words)]
    packed = indexed.groupBy("row_idx").agg(*aggs)
    zero = F.lit(0).cast("long")
    return rows.join(packed, "row_idx", "left").select(*rows.columns, *[F.coalesce(f"w{k}", zero).alias(f"w{k}") for k in range(words)])


def differing(a: str, b: str, words: int) -> Column:
    """Cells that differ between the packed rows of aliases a and b."""
    return reduce(add, [F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(words)]).cast("int")


def human_bytes(n: int) -> str:
    """Bytes in binary units: 100 Bytes, 1.5 KiB."""
    if n < 1024:
        return "1 Byte" if n == 1 else f"{n} Bytes"
    x, units = float(n), ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    for u in units:
        x /= 1024
        if x < 1024 or u == units[-1]:
            return f"{x:.1f} {u}"
    raise AssertionError
