import os
from collections import defaultdict

import pytest

from cardloom.llm import common


def test_least_of_is_the_least_of_each_key(spark):
    rows = [("hot" if k % 3 else f"k{k % 7}", (k * 7919) % 10_007 if k % 5 else 3, k) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key string, h long, v long").repartition(9)
    want = defaultdict(set)
    for key, h, _ in rows:
        want[key].add(h)
    for most in (20_000, 100):
        got = common.least_of(df, "key", "h", 40, rows=most)
        assert [(r["key"], r["h"]) for r in got] == [(k, h) for k in sorted(want) for h in sorted(want[k])[:40]]
    assert common.least_of(df.where("false"), "key", "h", 40) == []


def test_saved_tables_are_removed(spark):
    mark = common.written()
    kept = common.saved(spark.range(5), "a")
    gone = common.saved(spark.range(6), "b")
    path = gone.inputFiles()[0].removeprefix("file://")
    last = common.saved(spark.range(7), "c")
    common.remove_saved(spark, mark + 1, keep=1)
    assert kept.count() == 5 and last.count() == 7 and not os.path.exists(path)
    common.remove_saved(spark, mark)
    assert common.written() == mark


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session)
