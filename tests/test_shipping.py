import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from trajkit.operators import tokens
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([('{{"messages": []}}',)], "raw_json string")
print("GOT", tokens.supervised_examples(rows, lambda: (None, None), 10).first()["drop_reason"])
"""


def test_workers_need_no_installed_package(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT no_assistant" in out.stdout, out.stderr[-2000:]
