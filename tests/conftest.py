import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

from reviewloom.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from querybook.inputs import Tables

    return Tables(spark, SMALL)


@pytest.fixture
def column(spark):
    """Apply a Column function to a list of texts: column(function, texts) -> values."""

    def apply(function, values, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
        rows = df.select("i", function(df["c"]).alias("out")).collect()
        return [row.out for row in sorted(rows, key=lambda row: row.i)]

    return apply
