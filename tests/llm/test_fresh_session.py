"""A session that names no shared folder: a new process with an empty configuration folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
for name in ("op1_best_fit_packing", "op10_ngram_jaccard_join", "pipeline"):
    assert e.queries()[name](spark, SF).count() > 0, name
"""


def test_without_a_checkpoint_folder(sf, tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", f"SF = {sf!r}\n{CODE}"], cwd=REPO, env=env, check=True, timeout=600)
