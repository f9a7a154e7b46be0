import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as e
rows = e.entry(spark).collect()
n = e.queries()["clean_qrels"](spark, "/root/testdata/sf0.001").count()
print("OK", len(rows), n)
"""


def test_runs_from_another_directory(tmp_path):
    """Executors' Python workers do not see the repository on their path: the
    package's task functions must travel by value."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK 5" in out.stdout
