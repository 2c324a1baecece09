"""All operators' queries run where the workers cannot import the package."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])

#: Runs every query in one session from a folder that is not the repository; workers get no path to it.
RUN = """
import json, os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spark.range(1).mapInPandas(lambda b: b, "id long").count()  # the workers' server starts without the repository
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
failed = {}
for name, query in entry.queries().items():
    if name.startswith(sys.argv[2]):
        try:
            query(spark, "/root/testdata/sf0.001").count()
        except Exception as e:
            failed[name] = str(e)[-300:]
print("RESULT" + json.dumps(failed))
"""


def run_queries(tmp_path, names: str) -> dict:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN, REPO, names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    assert "RESULT" in done.stdout, done.stderr[-2000:]
    return json.loads(done.stdout.split("RESULT")[1])


@pytest.mark.parametrize("names", ["op"])
def test_operators(tmp_path, names):
    assert run_queries(tmp_path, names) == {}
