"""Sinks: NPY with JSON, CSV, Parquet, JSON statistics, BED and FASTA."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.model import AlleleFrame


def write_npy(frame: AlleleFrame, prefix: str, max_cells: int = 200_000_000) -> None:
    """{prefix}_matrix.npy and {prefix}_headers.json."""
    np.save(f"{prefix}_matrix.npy", frame.get_matrix(max_cells))
    Path(f"{prefix}_headers.json").write_text(json.dumps(frame.get_headers()))


def write_parquet(frame: AlleleFrame, path: str) -> None:
    """Long cells, sorted by allele within files so that scans can skip."""
    frame.presence.repartition("allele").sortWithinPartitions("allele", "guid").write.mode("overwrite").parquet(path)


def write_csv(frame: AlleleFrame, path: str, max_cells: int = 1_000_000_000) -> None:
    """Wide lines of 0 and 1 as text, built in tasks without a column per allele; one file, in matrix order, after a
    header line. Refused above max_cells, as one task writes it: write_parquet has no such bound."""
    n, m = frame.n_guids(), frame.n_alleles()
    if n * m > max_cells:
        raise ValueError(f"{n} x {m} cells are more than max_cells; use write_parquet")
    order = [r.col_idx for r in frame.alleles.orderBy("col_idx").select("col_idx").collect()]
    names = [r.allele for r in frame.alleles.orderBy("col_idx").select("allele").collect()]
    place = np.searchsorted(order, np.arange((order[-1] if order else 0) + 1))

    def text(values: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(values)
        return out.getvalue()

    def lines(batches):
        for b in batches:
            out = []
            for guid, cols in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                row = np.full(m, "0", object)
                row[place[cols or []]] = "1"
                out.append(",".join([text([guid]), *row]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row_idx", "value"])

    own = frame.indexed().groupBy("row_idx").agg(F.collect_list("col_idx").alias("cols"))
    rows = frame.labels.join(own, "row_idx", "left").select("row_idx", "guid", "cols").mapInArrow(lines, "row_idx int, value string")
    head = frame.spark.createDataFrame([(-1, text(["", *names]))], "row_idx int, value string")
    head.union(rows).coalesce(1).sortWithinPartitions("row_idx").select("value").write.mode("overwrite").text(path)


def write_distances(pairs: DataFrame, path: str) -> None:
    """Long pairs as CSV."""
    pairs.write.mode("overwrite").option("header", True).csv(path)


def wide_distances(squared: DataFrame, guids: list[str]) -> DataFrame:
    """A square matrix with a column per sample, in order."""
    return squared.groupBy("guid_a").pivot("guid_b", guids).agg(F.first("distance"))


def write_stats(frame: AlleleFrame, path: str) -> None:
    """Total and unique alleles of each sample as JSON."""
    frame.unique_per_sample().write.mode("overwrite").json(path)


BED = "chrom string, start long, end long, description string, sample string"


def write_bed(bed: DataFrame, path: str, skip_existing: bool = False) -> None:
    """A folder per sample with tab-separated rows and no header; with skip_existing samples that have one stay as they are."""
    if skip_existing:
        try:
            bed = bed.join(read_bed(bed.sparkSession, path).select("sample").distinct(), "sample", "left_anti").select(*bed.columns)
        except AnalysisException:
            pass  # nothing there yet
    bed.write.mode("append" if skip_existing else "overwrite").partitionBy("sample").option("sep", "\t").option("header", False).csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """What write_bed wrote."""
    return spark.read.schema(BED).option("sep", "\t").csv(path)


def fasta(frame: AlleleFrame, name: str, sequence: str) -> DataFrame:
    """(guid, sequence): a reference with each sample's alleles REFposALT applied; one that doesn't fit is left out."""
    parts = frame.presence.select("guid", F.regexp_extract("allele", r"^(.)(\d+)(.)$", 1).alias("ref"), F.expr("try_cast(regexp_extract(allele, '^(.)(\\\\d+)(.)$', 2) as int)").alias("pos"), F.regexp_extract("allele", r"^(.)(\d+)(.)$", 3).alias("alt"))
    fits = parts.where(F.col("pos").between(1, len(sequence)) & (F.substring(F.lit(sequence), F.col("pos"), F.lit(1)) == F.col("ref")))
    edits = fits.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("pos", "alt"))).alias("e"))
    done = F.aggregate("e", F.lit(sequence), lambda s, e: F.concat(F.substring(s, F.lit(1), e["pos"] - 1), e["alt"], F.substring(s, e["pos"] + 1, F.lit(len(sequence)))))
    return frame.guids.join(edits, "guid", "left").select("guid", F.coalesce(done, F.lit(sequence)).alias("sequence"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "guid", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)
