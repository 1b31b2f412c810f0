"""Driver contract: entry smoke run, registry consistency, and every SQL
oracle against its Spark query on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["Product_ID", "demand", "revenue", "avg_price"]


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    msg = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package from the driver: neither their folder nor their path holds it."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", "{tmp_path}/checkpoints").getOrCreate())
spec = importlib.util.spec_from_file_location("entry", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("ROWS", entry.queries()["poly_ridge_metrics"](spark, "{SF_SMALL}").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 25" in done.stdout, done.stderr[-2000:]


def _entry_without(tmp_path, package):
    """The names of the queries when ``package`` can't be imported."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = f"""
import sys
sys.modules["{package}"] = None
sys.path.insert(0, "{root}")
import __spark_entry__ as E
print("NAMES", *E.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    return done, done.stdout.partition("NAMES")[2].split()


@pytest.mark.parametrize("package", ["xxhash", "corpus_pipeline", "demandlens.llm"])
def test_entry_survives_without_the_training_part(tmp_path, package):
    done, names = _entry_without(tmp_path, package)
    assert "top_products" in names and "pipeline" not in names, done.stderr[-2000:]


def test_entry_needs_the_rest(tmp_path):
    done, names = _entry_without(tmp_path, "demandlens.forecast.seasonal")
    assert not names and done.returncode
