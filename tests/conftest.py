import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from pricelens.session import prepare
    d = tempfile.mkdtemp(prefix="pricelens-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("pricelens-tests")
         .config("spark.checkpoint.dir", d)
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    prepare(s)
    yield s
    s.stop()


def one_col(spark, values, name="v", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")
