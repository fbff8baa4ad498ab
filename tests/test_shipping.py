import os
import subprocess
import sys

from tests.conftest import SMALL

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["post_titles"](spark, sys.argv[2]).count())
"""


def test_queries_run_from_any_folder(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script), entry, SMALL], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240
    )
    assert "rows 50" in done.stdout, done.stderr[-2000:]
