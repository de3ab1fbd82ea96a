"""Problem 5: frequency of every distinct value or term.

Method: recursive radix spilling. Rows are partitioned by the hash bits of their terms into folders of the shared
folder, by the tasks that read them and without an exchange. A partition above a bound is read again, alone, and split
by further bits; one that holds a single hot term is split by the bits of its records. Each leaf is aggregated by one
task with DuckDB, which reads the leaf's files and spills beside them. Counts of a split term add up exactly, as its
leaves hold different records.

The folder must be a file system that all executors see, as DuckDB opens its files by path: an error says so otherwise.
Defined cases: rows with a null term or record count nowhere; repeated rows count as rows but once as records; listed
terms without rows get 0 and 0; an empty table gives zero counts; other columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.shared import scan_bytes, shared_folder

#: Rows of a leaf at most, and so of a task; larger partitions are split.
PART_ROWS = 2_000_000
#: Bits of the first level by the size of the input: a partition for every PART_BYTES of it.
LEAST_BITS, MOST_BITS, PART_BYTES = 4, 8, 16 << 20
MORE_BITS = 4
DUCKDB_MEMORY = "256MB"
#: The optimiser's size of what it can't tell is beyond this.
UNKNOWN = 1 << 60


def _bits(col, start: int, n: int):
    return F.shiftrightunsigned(col, 64 - start - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _scratch(spark) -> str:
    """The shared folder as a path that tasks can open."""
    folder = shared_folder(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("terms are counted in files that DuckDB opens: spark.checkpoint.dir must be on a shared file system")
    path = "/" + folder.removeprefix("file:").lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


_SPILLED = "term string, rec string, part string"


def _spill(cells: DataFrame, part, path: str) -> dict[str, tuple[int, bool]]:
    """Writes cells(term, rec) below path, a folder for each value of part; rows of each, and whether it is one term alone."""
    spark = cells.sparkSession
    cells.select("term", "rec", part.cast("string").alias("part")).write.option("compression", "zstd").partitionBy("part").parquet(f"file://{path}")
    held = spark.read.schema(_SPILLED).parquet(f"file://{path}")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"), (F.min("term") == F.max("term")).alias("alone"))
    return {r.part: (r.n, r.alone) for r in sizes.collect()}  # a row for each leaf or partition to split


def _leaves(cells: DataFrame, root: str, bits: int, part_rows: int) -> list[tuple[str, bool]]:
    """Folders of the leaves, and whether a leaf has part of a term's records only. A level splits its partitions in one job."""
    spark, term, rec = cells.sparkSession, F.xxhash64("term"), F.xxhash64("rec", F.lit(7))
    out: list[tuple[str, bool]] = []
    path, level, by_record = f"{root}/0", 0, set()
    sizes = _spill(cells, _bits(term, 0, bits), path)
    while True:
        last = MORE_BITS * (level + 1) > 64
        big = {k: alone for k, (n, alone) in sizes.items() if n > part_rows and not last}
        out += [(f"{path}/part={k}", k in by_record) for k in sorted(sizes) if k not in big]
        if not big:
            return out
        # one term alone, or no bits of terms left: split by the records'
        record = {k for k, alone in big.items() if alone or k in by_record or bits + MORE_BITS * (level + 1) > 64}
        kinds = F.broadcast(spark.createDataFrame([(k, k in record) for k in big], "part string, by_record boolean"))
        again = spark.read.schema(_SPILLED).parquet(f"file://{path}").where(F.col("part").isin(list(big))).join(kinds, "part")
        more = F.when(F.col("by_record"), _bits(rec, MORE_BITS * level, MORE_BITS)).otherwise(_bits(term, bits + MORE_BITS * level, MORE_BITS) if bits + MORE_BITS * (level + 1) <= 64 else F.lit(0).cast("long"))
        path, level = f"{root}/{level + 1}", level + 1
        sizes = _spill(again, F.concat_ws("-", "part", more), path)
        by_record = {k for k in sizes if k.rpartition("-")[0] in record}


_COUNTS = pa.schema([("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64())])


def _aggregate(scratch: str):
    """DuckDB over the files of each leaf, with its own files in a folder of the task below scratch."""

    def run(batches):
        import duckdb

        for b in batches:
            for leaf in b.column(1).to_pylist():
                folder = tempfile.mkdtemp(prefix="radix-", dir=scratch)
                try:
                    con = duckdb.connect(f"{folder}/leaf.db", config={"memory_limit": DUCKDB_MEMORY, "threads": "1", "temp_directory": folder})
                    got = con.sql(
                        "select term, sum(n)::bigint as n_rows, count(*)::bigint as n_records from "
                        f"(select term, rec, count(*) as n from read_parquet('{leaf}/*.parquet', hive_partitioning = false) group by term, rec) group by term"
                    ).to_arrow_table()
                    yield from got.cast(_COUNTS).to_batches(max_chunksize=20_000)
                    con.close()
                finally:
                    shutil.rmtree(folder, ignore_errors=True)

    return run


def term_counts(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(term, n_rows, n_records) of rows(term, rec), and the table of (term, rec) as it was first spilled."""
    spark = rows.sparkSession
    cells = rows.where(F.col("term").isNotNull() & F.col("rec").isNotNull()).select("term", "rec")
    expected = scan_bytes(rows)
    bits = LEAST_BITS if expected >= UNKNOWN else min(MOST_BITS, max(LEAST_BITS, (expected // PART_BYTES).bit_length()))
    scratch = _scratch(spark)
    root = f"{scratch}/p5-radix-{uuid.uuid4().hex[:8]}"
    leaves = _leaves(cells, root, bits, part_rows)
    spilled = spark.read.schema(_SPILLED).parquet(f"file://{root}/0").select("term", "rec")
    if not leaves:
        return spark.createDataFrame([], "term string, n_rows long, n_records long"), spilled
    listed = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(leaves)], "i int, path string")
    counts = listed.repartitionById(len(leaves), F.col("i")).mapInArrow(_aggregate(scratch), "term string, n_rows long, n_records long")
    if any(shared for _, shared in leaves):
        counts = counts.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))
    return counts, spilled


def marked_terms(rows: DataFrame, listed: DataFrame, rare_at_most: int = 2, common_above: float = 0.5, part_rows: int = PART_ROWS) -> DataFrame:
    """(term, n_rows, n_records, mark) of every term of listed(term); mark is rare, common or null."""
    counts, cells = term_counts(rows, part_rows)
    total = cells.agg(F.count_distinct("rec")).first()[0]
    known = listed.where(F.col("term").isNotNull()).select("term").distinct()
    n = F.coalesce("n_records", F.lit(0).cast("long"))
    # the optimiser sees the few rows that name the leaves, not what comes of them: it must not broadcast
    return known.join(counts.hint("merge"), "term", "left").select(
        "term",
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        n.alias("n_records"),
        F.when(n <= rare_at_most, "rare").when(n > common_above * total, "common").alias("mark"),
    )


__all__ = ["marked_terms", "term_counts"]
