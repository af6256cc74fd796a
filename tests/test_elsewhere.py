"""The driver file works when it is loaded by path from another working directory."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_file", sys.argv[1])
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("q_custom_formatter", "q_encode_file"):
    print(name, len(module.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_python_plug_ins_reach_the_workers(folder):
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(entry)], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["q_custom_formatter", "200", "q_encode_file", "200"], done.stderr[-2000:]
