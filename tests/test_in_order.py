"""Streams that arrive in disorder, against folds over sorted rows."""

import random
from datetime import datetime, timedelta, timezone
from functools import partial

import pytest

from cardloom.plans import streaming
from cardloom.plans.base import Inputs
from cardloom.streaming import jobs
from cardloom.streaming.in_order import started
from cardloom.streaming.jobs import fold_mean

from .test_oracle import compare, duck  # noqa: F401
from .test_pieces import runs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session_id long, event_id long, ts timestamp, x_left double, top double, width double, fill double"


def frame(session, event, minute, r):
    return (session, event, START + timedelta(minutes=minute), None if r.random() < 0.05 else 20 + r.random() * (1 if r.random() < 0.9 else 9), 15.0, 40.0, 50.0)


def streamed(spark, tmp_path, batches, schema, make, beat):
    at = str(tmp_path / f"in{len(batches)}")
    for rows in [*batches, [beat]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at))
    writer = out.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-state").trigger(availableNow=True)
    started(writer, spark).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return spark.read.parquet(f"{at}-out").collect()


def test_one_batch_and_many_shuffled_ones_agree(spark, tmp_path):
    r = random.Random(3)
    rows = [frame(r.choice([1, 1, 1, 2, 3]), k, k // 2, r) for k in range(240)]
    want = {}
    for s in (1, 2, 3):
        want |= runs([(s, x[2], x[1], *x[3:]) for x in sorted(rows, key=lambda x: (x[2], x[1])) if x[0] == s])
    moved = sorted(rows, key=lambda x: x[1] + r.randrange(60))  # up to half an hour out of place
    beat = (1, None, START + timedelta(days=9), None, None, None, None)
    for batches in ([rows[::-1]], [moved[k : k + 20] for k in range(0, 240, 20)]):
        got = streamed(spark, tmp_path, batches, SCHEMA, lambda s: jobs.stability_stream(s, "40 minutes"), beat)
        assert not any(x.late for x in got) and len(got) == 240
        assert {x.event_id: x.run for x in got} == want


def test_late_rows_come_out_marked(spark, tmp_path):
    r = random.Random(4)
    batches = [[frame(1, k, k, r) for k in range(0, 100, 2)], [frame(1, k, k, r) for k in range(100, 200, 2)], [frame(1, 3, 3, r), frame(1, 191, 191, r)]]
    beat = (1, None, START + timedelta(days=9), None, None, None, None)
    got = streamed(spark, tmp_path, batches, SCHEMA, lambda s: jobs.stability_stream(s, "10 minutes"), beat)
    assert sorted(x.event_id for x in got) == sorted([3, 191, *range(0, 200, 2)])
    assert [(x.event_id, x.run) for x in got if x.late] == [(3, None)]
    taken = sorted((x for b in batches for x in b if x[1] != 3), key=lambda x: x[2])
    assert {x.event_id: x.run for x in got if not x.late} == runs([(1, x[2], x[1], *x[3:]) for x in taken])


def test_calibrations(spark, tmp_path):
    r = random.Random(5)
    schema = "device long, kind string, event_id long, ts timestamp, x double, y double"
    rows = [(r.choice([1, 2]), "std", k, START + timedelta(seconds=k), r.random(), r.random()) for k in range(90)]
    shuffled = r.sample(rows, 90)
    got = streamed(spark, tmp_path, [shuffled[:40], shuffled[40:60], shuffled[60:]], schema, lambda s: jobs.calibration_stream(s, ["x", "y"]), (1, "std", None, START + timedelta(days=1), None, None))
    for device in (1, 2):
        own = [x for x in rows if x[0] == device]
        last = max((x for x in got if x.device == device), key=lambda x: x["count"])
        count, mean = fold_mean(0, [], [list(x[4:]) for x in own])
        assert last["count"] == count == len(own) and [last.x, last.y] == pytest.approx(mean)


def test_rows_of_one_millisecond_and_large_ids_beside_a_heartbeat(spark, tmp_path):
    at = lambda micros: START + timedelta(microseconds=micros)
    big = 2**60
    # by time the frames lie at 20, 29, 29, 29; by id at 29, 29, 29, 20
    rows = [(s, big + 10 * k + (3 - n), at(100 * n), 29.0 if n else 20.0, 15.0, 40.0, 50.0) for k, s in enumerate([big + 1, big + 2, None]) for n in range(4)]
    first = (1, None, START, None, None, None, None)
    beat = (1, None, START + timedelta(days=9), None, None, None, None)
    got = streamed(spark, tmp_path, [[first, *rows]], SCHEMA, lambda s: jobs.stability_stream(s, "10 minutes"), beat)
    want = {(s, big + 10 * k + (3 - n)): [1, 1, 2, 3][n] for k, s in enumerate([big + 1, big + 2, None]) for n in range(4)}
    assert {(x.session_id, x.event_id): x.run for x in got} == want and len(got) == len(want) and not any(x.late for x in got)


def test_state_does_not_grow_by_a_value_a_key(spark, tmp_path):
    at, n = str(tmp_path / "in"), 3000
    for minutes, ids in ((0, range(n)), (9 * 1440, [None])):
        rows = [(k or 0, k, START + timedelta(minutes=minutes), 20.0, 15.0, 40.0, 50.0) for k in ids]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
    out = jobs.stability_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at))
    writer = out.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-state").trigger(availableNow=True)
    query = started(writer, spark)
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < n / 2
    assert sorted((x.event_id, x.run) for x in spark.read.parquet(f"{at}-out").collect()) == [(k, 1) for k in range(n)]


def test_batches_of_several_files(spark, duck, sf, tmp_path, monkeypatch):  # noqa: F811
    with monkeypatch.context() as m:
        m.setattr(streaming, "scratch", lambda f: str(tmp_path / "landed"))
        rows = Inputs(spark, sf).events.count()
        streaming.disordered(Inputs(spark, sf), per_file=max(1, rows // 20))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    assert len(landed.inputFiles()) == 4 * (streaming.BATCHES + 1) and landed.where("event_id IS NOT NULL").count() == rows
    monkeypatch.setattr(streaming, "disordered", partial(streaming.disordered, per_file=max(1, rows // 20)))
    assert compare(spark, duck, sf, "t3_stability_stream") == rows
