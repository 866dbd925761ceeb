"""Stored tables that change: what is written, what stays, and what readers see."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardloom.operators import collection
from cardloom.sources import stored_tables as t
from cardloom.streaming import jobs


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_updates_rewrite_only_touched_partitions(spark, tmp_path):
    at = str(tmp_path / "scans")
    rows = [(k, f"n{k}", None if k % 4 == 0 else float(k), f"2024-01-{1 + k % 5:02d}") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, price double, day string")
    df.write.partitionBy("day").parquet(at)
    before = files(at)
    changes = spark.createDataFrame(
        [(1, "new", None, None, False), (6, "n6", None, None, False), (11, None, None, ["price"], False), (16, None, None, ["price"], False), (21, None, None, None, True), (999, "x", None, None, False)],
        "id long, name string, price double, set_null array<string>, deleted boolean",
    )
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    assert t.update_stored(spark, at, changes, now=now) == 1
    after = files(at)
    assert {f for f in before if "day=2024-01-02" not in f} == {f for f in after if "day=2024-01-02" not in f}
    assert not {f for f in before if "day=2024-01-02" in f} & after
    got = {r.id: r for r in spark.read.option("mergeSchema", True).parquet(at).collect()}
    assert len(got) == 49 and 21 not in got
    assert got[1].name == "new" and got[11].price is None
    # 6 and 16 are named by a change that leaves them as they were
    assert {k for k, r in got.items() if r.updated_at} == {1, 11}
    whole = spark.createDataFrame([(k, True) for k in range(50) if k % 5 == 3], "id long, deleted boolean")
    assert t.update_stored(spark, at, whole) == 1
    assert not any("day=2024-01-04" in p for p in os.listdir(at)) and spark.read.parquet(at).count() == 39
    assert t.update_stored(spark, at, whole) == 0


def test_deletion_writes_bitmaps_only(spark, tmp_path):
    at = str(tmp_path / "scans")
    df = spark.range(1000).select("id", (F.col("id") % 37).alias("user_id"), F.lit("x" * 50).alias("_file"))
    df.repartition(6).write.parquet(at)
    before = files(at)
    for users in ([3, 5], [5, 7, 99], []):
        t.delete_rows(spark, at, spark.createDataFrame([(u,) for u in users], "u long"), "user_id")
    assert {f for f in files(at) if not f.startswith(t.DELETED)} == before
    want = sorted(tuple(r) for r in df.where(~F.col("user_id").isin(3, 5, 7)).collect())
    assert sorted(tuple(r) for r in t.read_live(spark, at).collect()) == want
    assert spark.read.parquet(at).count() == 1000
    assert t.fold_deletions(spark, at) > 0 and t.DELETED not in os.listdir(at)
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == sorted(tuple(r) for r in t.read_live(spark, at).collect()) == want
    assert t.fold_deletions(spark, at) == 0


def test_a_killed_write_is_invisible(spark, tmp_path):
    at = str(tmp_path / "catalog")
    with pytest.raises(FileNotFoundError):
        t.read_written_catalog(spark, at)
    cards = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 3 == 1, "saved").alias("status"))
    made = t.write_catalog(cards, at, "v1", F.col("status"))
    assert made["count"] == 90 and made["report"] == {"saved": 30, "failed": 30, "skipped": 0, "other": 30}
    bad = cards.withColumn("id", F.when(F.col("id") < 80, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).cast("long"))
    with pytest.raises(Exception, match="killed"):
        t.write_catalog(bad, at, "v2")
    cards.limit(5).write.parquet(f"{at}/cards-unfinished")
    assert t.read_written_catalog(spark, at).count() == 90 and t.read_manifest(spark, at).first().version == "v1"
    t.write_catalog(cards.limit(7), at, "v3")
    assert t.read_written_catalog(spark, at).count() == 7 and t.read_manifest(spark, at).first()["count"] == 7
    assert all(json.loads(p.read_text())["version"] in ("v1", "v3") for p in Path(at).glob("manifest-*.json"))


def test_a_write_is_one_job(spark, tmp_path):
    group = "one-write"
    spark.sparkContext.setJobGroup(group, "")
    t.write_catalog(spark.range(10), str(tmp_path / "c"))
    jobs_ = [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs_) <= 2  # the write, and the day's literal where Spark does not fold it


def test_totals_follow_random_changes(spark):
    r = random.Random(6)
    schema = "id long, user_id long, eur double, ai_score long, raw_score long"
    row = lambda k: (k, r.randrange(5), r.choice([None, round(r.random() * 90, 3)]), r.choice([None, 0, 700]), r.choice([None, 0, 850, 990]))
    table = {k: row(k) for k in range(60)}
    df = lambda rows: spark.createDataFrame(list(rows), schema)
    say = lambda x: sorted(tuple(r) for r in x.collect())
    totals = collection.collection_totals(df(table.values()))
    for _ in range(3):
        gone, changed, added = r.sample(sorted(table), 9), r.sample(sorted(table), 9), [max(table) + 1 + k for k in range(6)]
        changed = [k for k in changed if k not in gone]
        old = [table[k] for k in (*gone, *changed)]
        for k in gone:
            del table[k]
        for k in (*changed, *added):
            table[k] = row(k)
        totals = collection.merge_totals(totals, collection.totals_delta(df(old), df([table[k] for k in (*changed, *added)])))
        totals = spark.createDataFrame(totals.collect(), totals.schema)
        assert say(totals.select("user_id", *collection.TOTALS)) == say(collection.merge_totals(collection.collection_totals(df(table.values()))).select("user_id", *collection.TOTALS))
        got, want = collection.stats_of_totals(totals), collection.collection_stats(df(table.values()))
        assert say(got.select(*want.columns)) == say(want)
        want = collection.collection_value(df(table.values()))
        assert say(got.select(*want.columns)) == say(want)


def test_known_cards_stay_known(spark, tmp_path):
    listing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "card_id string, ordinal long, name string"

    def land(*rows):
        spark.createDataFrame(list(rows), schema).repartition(3).write.mode("append").parquet(listing)

    def run():
        jobs.catalog_stream(spark.readStream.schema(schema).parquet(listing), out, state, order=["ordinal"], known=known).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select(*("card_id", "ordinal", "name")).collect())

    known = spark.createDataFrame([("k",)], "card_id string")
    land(("a", 5, "fifth"), ("a", 1, "first"), ("a", 3, "third"), ("b", 2, "b"), ("k", 0, "known"))
    assert run() == [("a", 1, "first"), ("b", 2, "b")]
    land(("a", 0, "later"), ("c", 9, "c"), ("c", 8, "c8"))
    assert run() == [("a", 1, "first"), ("b", 2, "b"), ("c", 8, "c8")]
    assert run() == [("a", 1, "first"), ("b", 2, "b"), ("c", 8, "c8")]
