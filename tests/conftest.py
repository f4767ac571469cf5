import os

import pytest
from pyspark.sql import SparkSession

from corpuscope.session import configure

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function on a list of values, in order."""
    from pyspark.sql import functions as F

    def run(function, items, type_name="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {type_name}")
        return [row.r for row in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]

    return run
