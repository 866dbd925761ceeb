"""A session that names no shared folder, and settings that queries leave alone."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from cardloom.plans import QUERIES
from cardloom.sources import shared

REPO = Path(__file__).resolve().parents[1]
CODE = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
for name in ("t4_catalog_stream", "s4_w6_embedding_chunks"):
    assert e.queries()[name](spark, SF).count() > 0, name
"""


def test_without_a_checkpoint_folder(sf, tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", f"SF = {sf!r}\n{CODE}"], cwd=REPO, env=env, check=True, timeout=600)


def test_a_cluster_must_name_a_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_pictures_leave_the_batch_size_alone(spark, sf):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert QUERIES["v1_v2_phash_equalized"](spark, sf).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
