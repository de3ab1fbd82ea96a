"""Sources: CSV, Parquet, NPY with JSON, memory, pandas, VCF and FASTA, all read into long cells."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.model import AlleleFrame
from presq.plans.index import with_index
from presq.plans.shared import materialize

FORMATS = ("csv", "parquet", "npy", "json")
#: Rows of a matrix file that one task turns into cells at a time.
SLAB_ROWS = 256


def infer_format(source, file_format: str | None = None) -> str:
    """csv, parquet, npy, json or memory; an extension is taken as it is written."""
    if file_format is not None:
        kind = file_format.lower()
    elif isinstance(source, list | tuple):
        if len(source) != 2:
            raise ValueError("a pair of sources is expected")
        if all(isinstance(x, str) for x in source):
            ends = [x.rsplit(".", 1)[-1] for x in source]
            if not set(ends) <= {"json", "npy"}:
                raise ValueError("two files are a matrix .npy and a header .json")
            return ends[0]
        if {type(x) is dict for x in source} == {True, False} and any(isinstance(x, np.ndarray) for x in source):
            return "memory"
        raise ValueError("a pair holds two paths, or an array and its headers")
    elif isinstance(source, str):
        kind = source.rsplit(".", 1)[-1]
    else:
        raise ValueError("a source is a path or a pair")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; it is one of {', '.join(FORMATS)}")
    return kind


def load(spark: SparkSession, source, file_format: str | None = None, **options) -> AlleleFrame:
    """The matrix of a source, by its format."""
    kind = infer_format(source, file_format)
    if kind == "memory":
        first, second = source
        return from_memory(spark, *((first, second) if isinstance(first, np.ndarray) else (second, first)), **options)
    if kind == "csv":
        return from_csv(spark, source, **options)
    if kind == "parquet":
        return from_parquet(spark, source, **options)
    if not isinstance(source, list | tuple):
        raise ValueError("a matrix file comes with its header file")
    matrix, headers = source if kind == "npy" else source[::-1]
    return from_npy(spark, matrix, headers, **options)


REF = "REF"
#: Rows of a matrix file: where a row lies, its label, and the columns and texts of its cells other than 0.
_ROWS = "file string, start long, at long, guid string, width int, cols array<int>, cells array<string>"


def _numbered(names: list[str]) -> list[tuple[int, str]]:
    return [(i, str(x)) for i, x in enumerate(names)]


def _labels(spark: SparkSession, guids, alleles) -> tuple[DataFrame, DataFrame]:
    for what, names in (("guid", guids), ("allele", alleles)):
        if len(set(map(str, names))) < len(names):
            raise ValueError(f"a {what} is given twice")
    return spark.createDataFrame(_numbered(guids), "row_idx int, guid string"), spark.createDataFrame(_numbered(alleles), "col_idx int, allele string")


def _is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _local(path: str) -> str:
    return unquote("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else path


def _cells(indexed: DataFrame, g: DataFrame, a: DataFrame) -> AlleleFrame:
    return AlleleFrame(indexed.join(g, "row_idx").join(a, "col_idx").select("guid", "allele"), g, a)


def _binary(matrix: np.ndarray, binarize: bool) -> np.ndarray:
    if matrix.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    if not binarize and not np.isin(matrix, (0, 1)).all():
        raise ValueError("cells are 0 or 1; binarize=True takes any other value for 1")
    return matrix != 0


def from_memory(spark: SparkSession, matrix: np.ndarray, headers: dict, binarize: bool = False, add_ref: bool = False) -> AlleleFrame:
    """From an array and {guids, alleles}; add_ref adds a row REF without cells."""
    ones = _binary(np.asarray(matrix), binarize)
    guids, alleles = list(headers["guids"]), list(headers["alleles"])
    if ones.shape != (len(guids), len(alleles)):
        raise ValueError(f"the matrix is {ones.shape}, its headers {(len(guids), len(alleles))}")
    g, a = _labels(spark, [*guids, "REF"] if add_ref else guids, alleles)
    r, c = np.nonzero(ones)
    return _cells(spark.createDataFrame([(int(i), int(j)) for i, j in zip(r, c, strict=True)], "row_idx int, col_idx int"), g, a)


def from_pandas(spark: SparkSession, frame, binarize: bool = False, add_ref: bool = False) -> AlleleFrame:
    """From a pandas frame with guids as its index and a column per allele."""
    return from_memory(spark, frame.to_numpy(), {"guids": list(frame.index), "alleles": list(frame.columns)}, binarize, add_ref)


def from_wide(wide: DataFrame, key: str = "guid", binarize: bool = False) -> AlleleFrame:
    """From a Spark frame with a column per allele, few enough to be columns: they are turned into rows."""
    names = [c for c in wide.columns if c != key]
    kept = wide.select(F.col(key).cast("string").alias("guid"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    long = kept.unpivot("guid", [F.col(f"`{c}`") for c in names], "allele", "value").where("value is not null")
    if not binarize and (bad := long.where(~F.col("value").isin(0.0, 1.0)).first()):
        raise ValueError(f"a cell of {bad.guid} is {bad.value}: cells are 0 or 1")
    a = wide.sparkSession.createDataFrame([(x,) for x in names], "allele string")
    return AlleleFrame.from_cells(long.where("value <> 0"), kept.select("guid"), a)


def from_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', binarize: bool = False, header: bool = True, index_col: int = 0, add_ref: bool = False) -> AlleleFrame:
    """From a wide CSV: lines are parsed in tasks, quotes and all, so width never becomes schema. Labels are strings.

    A record is a line: line breaks within quotes aren't supported. add_ref adds a row REF without cells.
    """

    def fields(line: str) -> list[str]:
        return [x.strip() for x in next(csv.reader([line], delimiter=delimiter, quotechar=quote, skipinitialspace=True))]

    text = spark.read.text(path).where(F.trim("value") != "")
    top = text.first()
    if top is None:
        raise ValueError("the file is empty")
    names = [x for i, x in enumerate(fields(top.value)) if i != index_col]
    if not header:
        names = [f"allele_{i}" for i in range(len(names))]

    def rows(batches):
        for b in batches:
            out = {k: [] for k in ("file", "start", "at", "guid", "width", "cols", "cells")}
            for file, start, at, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if header and line == top.value:
                    continue
                f = fields(line)
                guid = f.pop(index_col)
                own = [(i, x) for i, x in enumerate(f) if x != "0" and x != ""]
                for k, v in zip(out, (file, start, at, guid, len(f), [i for i, _ in own], [x for _, x in own]), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("guid", pa.string()), ("width", pa.int32()), ("cols", pa.list_(pa.int32())), ("cells", pa.list_(pa.string()))]))

    placed = text.select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), "value")
    return _from_rows(spark, placed.mapInArrow(rows, _ROWS), names, binarize, add_ref)


def _from_rows(spark: SparkSession, rows: DataFrame, names: list[str], binarize: bool, add_ref: bool) -> AlleleFrame:
    """The matrix of _ROWS, each file read once; guids are numbered in file order without a way over the driver."""
    rows = materialize(rows, "matrix-rows")
    if wide := rows.where(F.col("width") > len(names)).first():
        raise ValueError(f"the row {wide.guid} has {wide.width} cells for {len(names)} columns")
    if twice := rows.groupBy("guid").count().where("count > 1").first():
        raise ValueError(f"a guid is given twice: {twice.guid}")
    if len(set(names)) < len(names):
        raise ValueError("an allele is given twice")
    long = rows.select("guid", F.explode(F.arrays_zip("cols", "cells")).alias("c")).select("guid", F.col("c.cols").alias("col_idx"), F.col("c.cells").alias("cell"))
    value = F.expr("try_cast(cell as double)")
    if not binarize and (bad := long.where(value.isNull() | ~value.isin(0.0, 1.0)).first()):
        raise ValueError(f"a cell of {bad.guid} is {bad.cell!r}: cells are 0 or 1")
    g = with_index(rows.select(F.struct("file", "start", "at").alias("place"), "guid"), "place", "row_idx").select("row_idx", "guid")
    if add_ref:
        g = g.union(spark.createDataFrame([(rows.count(), REF)], "row_idx int, guid string"))
    a = spark.createDataFrame(_numbered(names), "col_idx int, allele string")
    p = long.where(value.isNotNull() & (value != 0)).join(a, "col_idx").select("guid", "allele")
    return AlleleFrame(p, g, a)


def from_parquet(spark: SparkSession, path: str, binarize: bool = False, add_ref: bool = False) -> AlleleFrame:
    """From long cells (guid, allele), or from a wide pandas file with guids as its index, read in row groups by tasks.

    Files that tasks can't open by path, those of object stores, are read whole by Spark, one a task.
    """
    columns = spark.read.parquet(path).columns
    if {"guid", "allele"} <= set(columns) and len(columns) <= 3:
        cells = spark.read.parquet(path)
        if "value" in columns:
            cells = cells.where("value <> 0")
        return AlleleFrame.from_cells(cells.select(F.col("guid").cast("string").alias("guid"), F.col("allele").cast("string").alias("allele")))
    index = next((c for c in columns if c.startswith("__index_level_")), "guid" if "guid" in columns else columns[-1])
    names = [c for c in columns if c != index]
    remote = _is_remote(spark.read.parquet(path).inputFiles()[0])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select("path", F.col("content") if remote else F.lit(None).cast("binary").alias("content"))

    def rows(batches):
        import pyarrow.parquet as pq

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for part in pq.ParquetFile(_local(file) if content is None else io.BytesIO(content)).iter_batches(batch_size=SLAB_ROWS):
                    ids = [str(x) for x in part.column(index).to_pylist()]
                    x = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names], 1) if names else np.zeros((len(ids), 0))
                    r, c = np.nonzero(x)
                    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=len(ids)))].astype(np.int32))
                    cols, cells = pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array([str(v) for v in x[r, c]], pa.string()))
                    number = pa.array(np.arange(at, at + len(ids)))
                    at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), pa.array(np.zeros(len(ids), np.int64)), number, pa.array(ids), pa.array(np.full(len(ids), len(names), np.int32)), cols, cells], names=["file", "start", "at", "guid", "width", "cols", "cells"])

    return _from_rows(spark, files.mapInArrow(rows, _ROWS), names, binarize, add_ref)


def from_npy(spark: SparkSession, matrix: str, headers: str, binarize: bool = False, add_ref: bool = False) -> AlleleFrame:
    """From {prefix}_matrix.npy, read in slabs of rows by tasks, and {prefix}_headers.json.

    A local matrix is mapped by the tasks, which need its path; one in an object store is read whole by one task.
    """
    head = read_headers(headers) if not _is_remote(headers) else _headers(json.loads(spark.read.text(headers, wholetext=True).first().value), headers)
    shape = (len(head["guids"]), len(head["alleles"]))
    remote = _is_remote(matrix)
    if not remote:
        found = np.load(_local(matrix), mmap_mode="r").shape
        if found != shape:
            raise ValueError(f"the matrix is {found}, its headers {shape}")
    g, a = _labels(spark, [*head["guids"], REF] if add_ref else head["guids"], head["alleles"])

    def slabs(batches):
        import pandas as pd

        for b in batches:
            x = np.load(io.BytesIO(b["content"].iloc[0])) if remote else np.load(_local(matrix), mmap_mode="r")
            if x.shape != shape:
                raise ValueError(f"the matrix is {x.shape}, its headers {shape}")
            for s in range(0, shape[0], SLAB_ROWS) if remote else b["id"]:
                r, c = np.nonzero(_binary(np.asarray(x[s : s + SLAB_ROWS]), binarize))
                yield pd.DataFrame({"row_idx": (r + s).astype("int32"), "col_idx": c.astype("int32")})

    parts = spark.read.format("binaryFile").load(matrix).select("content") if remote else spark.range(0, max(shape[0], 1), SLAB_ROWS)
    return _cells(parts.mapInPandas(slabs, "row_idx int, col_idx int"), g, a)


def _headers(head: dict, path: str) -> dict:
    if {"index", "columns"} <= set(head):
        head = {"guids": head["index"], "alleles": head["columns"]}
    if not {"guids", "alleles"} <= set(head):
        raise ValueError(f"{path} has no guids and alleles")
    return head


def read_headers(path: str) -> dict:
    """{guids, alleles} of a header file; one with keys index and columns is read too."""
    return _headers(json.loads(Path(_local(path)).read_text()), path)


def read_vcf(spark: SparkSession, path: str, min_qual: float = 30) -> DataFrame:
    """(file, sample, chrom, pos, ref, base, id, is_ref): each called copy of a one-base alternative in records of at
    least min_qual, and each genotype of two reference copies, whatever the record's quality, with is_ref.

    The sample is the column's name; id is chrom.pos.base.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    head = lines.where(F.col("value").startswith("#CHROM")).select("file", F.expr("slice(split(value, '\\t'), 10, size(split(value, '\\t')))").alias("samples"))
    f = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    rows = body.select("file", f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alt"), F.expr("try_cast(split(value, '\\t')[5] as double)").alias("qual"), F.split(f[8], ":").alias("format"), F.expr("slice(split(value, '\\t'), 10, size(split(value, '\\t')))").alias("calls"))
    rows = rows.join(F.broadcast(head), "file")
    calls = rows.select("*", F.posexplode("calls").alias("at", "call")).withColumn("sample", F.get("samples", F.col("at")))
    gt = F.split(F.get(F.split("call", ":"), F.array_position("format", "GT").cast("int") - 1), "[/|]")
    whole = F.size("gt") == F.size(F.filter("gt", lambda x: x == "0"))
    reference = (F.size("gt") == 2) & whole
    # a genotype of two reference copies is one row with k = 0; of others the alternative copies remain
    copies = calls.withColumn("gt", gt).withColumn("k", F.explode(F.when(reference, F.array(F.lit(0))).otherwise(F.filter(F.transform("gt", lambda x: x.try_cast("int")), lambda x: x > 0))))
    base = F.when(F.col("k") == 0, F.col("ref")).otherwise(F.get("alt", F.col("k") - 1))
    out = copies.withColumn("base", base).where((F.col("k") == 0) | ((F.length("base") == 1) & (F.col("qual") >= min_qual)))
    return out.select("file", "sample", "chrom", "pos", "ref", "base", F.concat_ws(".", "chrom", "pos", "base").alias("id"), (F.col("k") == 0).alias("is_ref"))


def from_vcf(spark: SparkSession, path: str, min_qual: float = 30, database: AlleleFrame | None = None) -> AlleleFrame:
    """The matrix of a merged VCF: cells are called alternatives; a genotype of two reference copies makes a column of
    the reference base without cells. With a database the matrix is merged into it."""
    calls = read_vcf(spark, path, min_qual)
    names = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.explode(F.expr("slice(split(value, '\\t'), 10, size(split(value, '\\t')))")).alias("guid"))
    cells = calls.where(~F.col("is_ref")).select(F.col("sample").alias("guid"), F.col("id").alias("allele"))
    frame = AlleleFrame.from_cells(cells, names, calls.select(F.col("id").alias("allele")))
    return frame if database is None else database.merge(frame)


def vcf_to_bed(spark: SparkSession, path: str, min_qual: float = 30) -> DataFrame:
    """(sample, chrom, start, end, description) of a VCF per sample: one row per copy, half-open from 0; the sample is the file's name up to its first dot."""
    calls = read_vcf(spark, path, min_qual).where(~F.col("is_ref"))
    sample = F.regexp_extract("file", r"([^/]+?)(\.[^/]*)?$", 1).alias("sample")
    return calls.select(sample, "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.col("id").alias("description"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    return records.select(name.alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))
