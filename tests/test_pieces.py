"""Ordered work on hot keys in pieces, against plain folds; the radius index against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import sequences, similarity


def folded(values):
    count, mean = 0, None
    for v in values:
        w = min(count, 5)
        mean = v if not count else (mean * w + v) / (w + 1)
        count += 1
    return count, mean


@pytest.mark.parametrize("rows", [7, 60, 100_000])
def test_calibration_of_a_hot_device(spark, rows):
    r = random.Random(rows)
    data = [(1 if r.random() < 0.9 else r.choice([2, 3, None]), "std", k, r.random()) for k in range(800)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "device long, kind string, event_id long, x double")
    got = {row.device: (row["count"], row.x) for row in sequences.calibrate_bounds(df, ["x"], rows=rows).collect()}
    for device in {d for d, *_ in data}:
        count, mean = folded([x for d, _, k, x in sorted(data, key=lambda t: t[2]) if d == device])
        assert got[device][0] == count and got[device][1] == pytest.approx(mean, abs=1e-9)
    for n in range(1, 12):
        one = spark.createDataFrame([(1, "std", k, k * k / 7) for k in range(n)], df.schema)
        assert sequences.calibrate_bounds(one, ["x"], rows=2).first()[2:] == (n, pytest.approx(folded([k * k / 7 for k in range(n)])[1]))


def runs(frames):
    out, last, run = {}, None, 0
    for key, ts, event, left, top, width, fill in frames:
        if left is None or not 15 < fill < 92:
            run = 0
        else:
            run = min(run + 1, 15) if run and all(abs(a - b) < 3 for a, b in zip((left, top, width), last, strict=True)) else 1
            last = (left, top, width)
        out[event] = run
    return out


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_frames_of_one_endless_session(spark, rows):
    r = random.Random(rows)
    frames, left = [], 20.0
    for k in range(900):
        left = left + 9 if r.random() < 0.03 else 20.0 + r.random()
        frames.append((1 if k < 850 else None, k // 2, k, None if r.random() < 0.02 else left, 15.0, 40.0, 50.0 if r.random() < 0.98 else 5.0))
    df = spark.createDataFrame(frames, "session_id long, ts long, event_id long, x_left double, top double, width double, fill double").repartition(5)
    got = sequences.stable_runs(df, rows=rows)
    assert got.columns == [*df.columns, "run"]
    want = runs(frames[:850]) | runs(frames[850:])
    assert {x.event_id: x.run for x in got.collect()} == want and max(want.values()) == 15


def test_a_hot_session_is_spread_evenly(spark):
    df = spark.range(20_000).select((F.col("id") % 10 == 0).cast("long").alias("session_id"), F.col("id").alias("ts"))
    sizes = [r["count"] for r in sequences.in_pieces(df, ("session_id", "ts"), 1000).groupBy("_piece").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * 20_000 / len(sizes)


def flipped(r, h, n):
    for b in r.sample(range(64), n):
        h ^= 1 << b
    return h


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 11, 15])
def test_every_pair_within_the_radius(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(12)]
    cards = [flipped(r, h, r.randrange(20)) for h in base for _ in range(15)] + [r.getrandbits(64) for _ in range(50)] + base
    q = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(base)], "query_id long, hash string")
    c = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(cards)], "card_id long, hash string")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(base) for j, b in enumerate(cards) if (a ^ b).bit_count() <= radius)
    assert sorted(tuple(x) for x in similarity.hamming_within(q, c, radius).collect()) == want


def test_radius_index_meets_few_pairs(spark):
    r = random.Random(1)
    q = spark.createDataFrame([(k, f"{r.getrandbits(64):016x}") for k in range(200)], "query_id long, hash string")
    c = spark.createDataFrame([(k, f"{r.getrandbits(64):016x}") for k in range(3000)], "card_id long, hash string")
    assert similarity.radius_candidates(q, c, 2).count() < 0.01 * 200 * 3000
    with pytest.raises(ValueError):
        similarity.hamming_within(q, c, 16)


def test_growing_radius_equals_all_cards(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    cards = [flipped(r, h, d) for k, h in enumerate(base) for d in ([0, 1, 1, 2, 3, 9] if k < 20 else [0, 14, 20])] + base[:3] * 4
    q = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(base)], "query_id long, hash string")
    c = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(cards)], "card_id long, hash string")
    say = lambda df: sorted(tuple(x) for x in df.select("query_id", "card_id", "distance", "rank").collect())
    for n in (1, 4):
        assert say(similarity.hamming_topn_near(q, c, n)) == say(similarity.hamming_topn(q, c, n))
    assert say(similarity.hamming_topn_near(q, c, 4, flips=0)) == say(similarity.hamming_topn(q, c, 4))
    few = c.limit(2)
    assert say(similarity.hamming_topn_near(q, few, 4)) == say(similarity.hamming_topn(q, few, 4))


def test_pruned_cosine_equals_all_blocks(spark):
    import numpy as np

    from cardloom.operators import pivots

    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 16))
    vectors = (centres[r.integers(0, 30, 1500)] + 0.05 * r.normal(size=(1500, 16))).tolist()
    vectors[3] = vectors[4] = [0.0] * 16
    vectors[9] = vectors[8]
    g = spark.createDataFrame([(f"c{k}", v) for k, v in enumerate(vectors)], "card_id string, embedding array<double>")
    q = spark.createDataFrame([(k, vectors[17 * k] if k % 3 else r.normal(size=16).tolist()) for k in range(60)] + [(99, [0.0] * 16)], "query_id long, embedding array<double>")
    say = lambda df: [(x.query_id, x.card_id, round(x.similarity, 9), x["rank"]) for x in df.orderBy("query_id", "rank").collect()]
    met = []
    assert say(pivots.cosine_topk_pruned(q, g, 5, pivots=60, size=40, met=met)) == say(similarity.cosine_topk(q, g, 5))
    assert met[0] < 0.4 * met[1]
    for k, n in ((1, 3), (2000, 8)):
        assert say(pivots.cosine_topk_pruned(q, g, k, pivots=n, size=500)) == say(similarity.cosine_topk(q, g, k))
    assert pivots.cosine_topk_pruned(q, g.limit(0), 3).count() == 0


def test_pruned_cosine_gathers_no_vectors_in_the_driver(spark):
    from cardloom.operators import pivots

    rows = [(k, [float((k * j) % 17 - 8) for j in range(1, 9)]) for k in range(1, 200)]
    g = spark.createDataFrame([(f"c{k}", v) for k, v in rows], "card_id string, embedding array<double>")
    q = spark.createDataFrame(rows[::9], "query_id long, embedding array<double>")
    best = pivots.cosine_topk_pruned(q, g, 3, pivots=8, size=20)
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.count() == 3 * len(rows[::9])
