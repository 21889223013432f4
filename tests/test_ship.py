"""Workers that can't import the package get it from the driver."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from terrafold.operators import spatial
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
regions = spark.createDataFrame([(1, "bbox", "0,0,1,1")], "region_id bigint, kind string, spec string")
points = spark.createDataFrame([(5, 5000000, 5000000), (6, 50000000, 5000000)], "id bigint, lon_i int, lat_i int")
assert [tuple(r) for r in spatial.inside(points, regions).collect()] == [(1, 5)]
print("done")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-2000:]
