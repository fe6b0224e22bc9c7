"""Tables in the shared folder: there while the driver lives, gone after it."""

import os
import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
from pyspark.sql import SparkSession
from ledgerloom.sources.shared import materialized
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert materialized(spark.range(5)).count() == 5
import os
print("tables", sum(x.startswith("table-") for x in os.listdir(sys.argv[1])))
spark.stop()
"""


def test_tables_go_with_the_driver(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "tables 1" in out.stdout, out.stderr[-500:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("table-")]
