"""Mixing: exact targets, hypergeometric quotas, disjoint blocks."""

import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from cardloom.llm import mixing as m


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def checked(rows, mixed):
    """Holds mix()'s rows against the documents (doc_id, source, text); gives the words taken of each source."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(words(text))
    targets = plain_targets(sizes)
    assert len(mixed) == len(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((i, s, len(words(t))) for i, s, t in rows)
    taken, lines = Counter(), defaultdict(Counter)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        own = sum(p.words for p in r.pieces)
        assert own <= 2 * r.size
        taken[r.source] += own
        for p in r.pieces:
            assert 0 <= p.start and p.start + p.words <= r.size
            lines[r.source].update(range(p.word, p.word + p.words))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.5 + 1e-6
        # the line of the source is taken whole as often as it fits, and parts of it once more
        passes = int(round(target) // sizes[source]) if sizes[source] else 0
        times = Counter(lines[source][w] for w in range(sizes[source]))
        assert set(times) <= {passes, passes + 1} and set(lines[source]) <= set(range(sizes[source]))
    return taken


def collected(df, **how):
    return m.mix(df, **how).collect()


SCHEMA = "doc_id long, source string, text string, target string, words array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", [1]) for r in rows], SCHEMA)


def corpus(n=120):
    sizes = [0, 1, 5, 17, 40, 333, 8]
    return [(k, ["a", "b", "ß", "c", "z", None][k % 11 % 6], " ".join(f"d{k}w{j}" for j in range(sizes[k % 7] * (1 + k % 3)))) for k in range(n)]


@pytest.mark.parametrize(("block", "shard_blocks"), [(256, 1 << 14), (7, 20), (1, 500)])
def test_words_come_out_at_the_targets(spark, block, shard_blocks):
    rows = corpus()
    got = collected(frame(spark, rows), block=block, shard_blocks=shard_blocks)
    checked(rows, got)


def test_reruns_agree_whatever_the_layout(spark):
    rows = corpus()
    say = lambda df: sorted(map(str, collected(df, block=7, shard_blocks=20)))
    want = say(frame(spark, rows))
    assert want == say(frame(spark, rows[::-1]).repartition(9, "doc_id"))
    assert want != sorted(map(str, collected(frame(spark, rows), block=7, shard_blocks=20, seed=2)))


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, "a", "x y"), (None, "a", "x y"), (1, "a", "x y"), (1, "a", "x y"), (1, "a", "other"), (2, None, None), (3, None, ""), (4, "b", long), (5, "c", " \t\r\n"), (6, "a", "p\x1cq\x85r s\x0bt")]
    checked(rows, collected(frame(spark, rows), block=16, shard_blocks=100))
    assert collected(frame(spark, [])) == []
    empty = [(1, "a", None), (2, "b", " ")]
    assert [len(r.pieces) for r in collected(frame(spark, empty))] == [0, 0] and checked(empty, collected(frame(spark, empty))) == Counter(a=0, b=0)


def test_one_source_and_equal_rows(spark):
    rows = [(7, "only", "so it goes on and on")] * 500
    got = collected(frame(spark, rows), block=4, shard_blocks=50)
    taken = checked(rows, got)
    assert taken["only"] == 1.5 * 3000


def test_weights_of_ones_own(spark):
    rows = [(k, s, "w " * 100) for k, s in enumerate("aabbcc")]
    weights = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "source string, weight double")
    got = {r.source: r.target for r in collected(frame(spark, rows), weights=weights, share=1.0)}
    assert got == {"a": 200.0, "b": 400.0, "c": 0.0}


def pmf(t, g, n):
    return {k: comb(g, k) * comb(t - g, n - k) / comb(t, n) for k in range(max(0, n - t + g), min(n, g) + 1)}


@pytest.mark.parametrize(("t", "g", "n"), [(10, 4, 5), (7, 7, 3), (9, 0, 4), (50, 49, 25), (1000, 333, 500), (6, 3, 6), (6, 3, 0), (40_000, 123, 20_000)])
def test_hypergeometric_inverts_the_distribution(spark, t, g, n):
    steps = 4000
    lit = lambda x: F.lit(x).cast("long")
    got = Counter(r.x for r in spark.range(steps).select(m.hypergeometric(lit(t), lit(g), lit(n), (F.col("id") + 0.5) / steps).alias("x")).collect())
    want = pmf(t, g, n)
    assert set(got) <= set(want) and all(abs(got[k] - p * steps) <= 1.001 for k, p in want.items())


def test_large_hypergeometric(spark):
    t, g, n = 3_000_000_000, 1_000_000_000, 1_500_000_000
    lit = lambda x: F.lit(x).cast("long")
    got = [r.x for r in spark.range(400).select(m.hypergeometric(lit(t), lit(g), lit(n), m.uniform(F.col("id"))).alias("x")).collect()]
    mean, sd = n * g / t, (n * (g / t) * (1 - g / t) * (t - n) / (t - 1)) ** 0.5
    assert abs(sum(got) / 400 - mean) < 0.15 * sd and 0.9 < (sum((x - mean) ** 2 for x in got) / 400) ** 0.5 / sd < 1.1


@pytest.mark.parametrize("shards", [1, 2, 7, 64, 100])
def test_tree_keeps_every_block(spark, shards):
    quotas = [9000, 0, 37, 2, 50_000]
    rows = m.shard_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), shards).orderBy("shard").collect()
    assert [r.shard for r in rows] == list(range(shards))
    assert [sum(r.quotas[k] for r in rows) for k in range(5)] == quotas
    sizes = [sum(r.quotas) for r in rows]
    assert max(sizes) - min(sizes) <= 7 and min(min(r.quotas) for r in rows) >= 0
    if shards == 100:
        assert len({tuple(r.quotas) for r in rows}) > 90


@pytest.mark.parametrize("count", [1, 2, 3, 10, 257, 1000])
def test_permutation(spark, count):
    two = spark.range(count).select(*(m.permuted(F.col("id"), F.lit(count).cast("long"), F.lit(k).cast("long")).alias(f"p{k}") for k in (1, 2))).collect()
    a, b = [r.p1 for r in two], [r.p2 for r in two]
    assert sorted(a) == sorted(b) == list(range(count))
    if count >= 257:
        assert a != b and sum(x == y for x, y in zip(a, range(count), strict=True)) < 12
        assert abs(sum(abs(a[i + 1] - a[i]) for i in range(count - 1)) / (count - 1) / count - 1 / 3) < 0.06


def test_shards_hold_their_quotas_and_texts(spark, tmp_path):
    rows = corpus()
    df = frame(spark, rows)
    mixed = m.mix(df, block=7, shard_blocks=20)
    texts = m.mixed_texts(df, mixed)
    got = texts.collect()
    by = {(i, s): words(t) for i, s, t in rows}
    for r in got:
        assert any(r.text == " ".join(w[r.start : r.start + r.words]) for (i, _), w in by.items() if i == r.doc_id)
    plans, shards = m.source_plans(m.source_targets(m.units(df), m.repeating_weights(m.units(df))), 7, 20)
    blocks = {}
    per = Counter((r.shard, r.source) for r in mixed.select("source", F.explode("pieces").alias("p")).select("source", "p.shard", "p.place").distinct().collect())
    for p in plans.collect():
        ends = [*p.starts[1:], p.draws]
        for k, (a, b) in enumerate(zip(p.starts, ends, strict=True)):
            blocks[k, p.source] = b - a
    assert shards > 10 and Counter({k: n for k, n in blocks.items() if n}) == per
    m.write_shards(texts, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(got) and back.select("shard").distinct().count() == shards


def test_no_python_in_the_plan(spark, sf):
    plan = m.op13_source_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query(spark, sf):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = m.op13_source_mixing(spark, sf).collect()
    sizes, taken = Counter(), Counter()
    by = {i: s for i, s, _ in docs}
    for i, s, t in docs:
        sizes[s] += len(words(t))
    for r in got:
        taken[by[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[by[r.doc_id]]
    want = plain_targets(sizes)
    assert len(got) == len(docs) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
