import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("demandlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        # tests run in local mode: a private folder is fine here
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="demandlens-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def demand_small(spark):
    from demandlens.sources.demand import demand_view
    return demand_view(spark, SF_SMALL).cache()
