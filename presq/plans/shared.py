"""Lineage cuts in the folder all executors share, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest side, in bytes of its rows, that is ever broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 8 << 20
_runs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a folder of our own only where that is unset and all
    tasks run in this process. On a cluster without the setting no folder is known to be shared: an error."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="presq-")
        _runs[app] = f"{root.rstrip('/')}/presq-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _runs[app])
    return _runs[app]


def _drop(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table made by materialize() that no later plan reads."""
    with suppress(AttributeError):
        _drop(df.sparkSession, df._presq_path)


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of the jobs inside are deleted as soon as each job ends."""
    before = spark.conf.get(CLEANUP, None)
    with suppress(Exception):
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with suppress(Exception):
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns its scan: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._presq_path = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that keep each below per_task rows, never fewer than the session's."""
    return max(shuffle_partitions(spark), -(-rows // per_task))


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows at row_bytes each stay below limit, else df: the join then shuffles."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= limit else df


def scan_bytes(df: DataFrame) -> int:
    """Bytes that the optimiser expects df to hold; for a scan, the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
