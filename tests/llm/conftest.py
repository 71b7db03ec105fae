import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/quern-warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Odd rows: nulls, empties, ties, repeated rows, non-ASCII, a very long text.
ODD = [
    (900001, None),
    (900002, ""),
    (900003, "   \n\t "),
    (900004, "ÄÖÜ Ärger CC BY cc-by CC  by Apache License, apache license"),
    (900005, "ÄÖÜ ÄRGER"),
    (900005, "ÄÖÜ ÄRGER"),
    (900006, "one"),
    (900007, "ONE"),
    (900008, "gnu general public license GNU General Public License mit license"),
    (900009, "word " * 60000 + "MIT License 192.168.0.1 mail a.b@c.de"),
    (None, "a row without an id"),
    (None, "one"),
    (900010, "\U0001f600 emoji \U0001f600 naïve cc by nc 4.0"),
]


@pytest.fixture
def odd(spark):
    """ODD with columns whose names operators use inside, and nulls in them."""
    rows = [(i, t, None, None, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, word string, key int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
