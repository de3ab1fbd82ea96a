import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

ROWS = {"1": "1000111101", "2": "1000111101", "3": "0100111101", "4": "0100111101", "5": "0100111101", "6": "0010111011", "7": "0010111011", "8": "0001101011", "9": "0001101011", "10": "0001101010"}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from presq.plans.ship import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden():
    """The hand-built 10 x 10 matrix and its headers."""
    import numpy as np

    matrix = np.array([[int(c) for c in row] for row in ROWS.values()], np.uint8)
    return matrix, {"guids": [f"GUID{i}" for i in ROWS], "alleles": [f"SNP{i}" for i in range(1, 11)]}


@pytest.fixture(scope="session")
def frame(spark, golden):
    from presq.sources.loaders import load

    return load(spark, list(golden)).persist()
