"""Golden values of scales and functions, and the traps in them."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions import scales, scores, text
from cardloom.operators import collection, grading, sequences, similarity


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize("company", scales.COMPANIES)
def test_every_band_limit(spark, company):
    rows = [(float(s), g, label) for g, label, lo, hi in scales.BANDS[company] for s in (lo, hi)]
    low = scales.BANDS[company][-1]
    rows += [(949.5 if company == "tag" else 1000.5, low[0], low[1]), (1001.0, low[0], low[1]), (50.0, low[0], low[1])]
    df = spark.createDataFrame(rows, "score double, grade double, label string").withColumn("g", scales.grade_from_score(F.col("score"), company))
    assert df.where("g.grade <> grade or g.label <> label").count() == 0
    assert one(spark, scales.grade_from_score(lit(900), "hga").alias("g")).g is None


def test_centering_tables(spark):
    r = one(
        spark, scales.centering_grade(lit(51.0), "front", "tag").alias("a"), scales.centering_grade(lit(99.0), "back", "psa").alias("b"), scales.centering_grade(lit(50.0), "top", "psa").alias("c"),
        scales.client_centering_score(lit(51.0), "front", "tag").alias("d"), scales.client_centering_score(lit(86.0), "front", "tag").alias("e"), scales.client_centering_score(lit(86.0), "back", "tag").alias("f"),
        scales.tag_centering_score(lit(52.0), "front").alias("g"), scales.tag_centering_score(lit(52.0), "front", "sports").alias("h"), scales.tag_centering_score(lit(90.0), "back").alias("i"),
    )
    assert tuple(r) == (9.0, 1.0, None, 995, 350, 700, 995, 970, 400)


def test_centering_scores_never_rise_with_the_offset(spark):
    df = spark.range(500, 1000).select((F.col("id") / 10).alias("o"))
    for c in scales.COMPANIES:
        got = [r[0] for r in df.select(scales.client_centering_score(F.col("o"), "front", c)).collect()]
        assert got == sorted(got, reverse=True)


def test_rounding_and_falsy_values(spark):
    r = one(
        spark, scores.half_up(lit(-0.5)).alias("a"), scores.half_up(lit(2.25), 1).alias("b"), scores.card_price_eur(lit(0.0), lit(None).cast("double"), lit(3.0)).alias("c"),
        scores.card_image(lit(""), lit("u"), lit("e")).alias("d"), scores.array_median(F.array(lit(3.0), lit(1.0), lit(2.0), lit(10.0))).alias("e"), scores.array_median(F.array().cast("array<double>")).alias("f"),
        scores.compound_client(lit(995), lit(970), lit(937.5)).alias("g"), scores.compound_backend(lit(100), lit(100), lit(100)).alias("h"),
    )
    assert tuple(r) == (0.0, 2.3, 3.0, "u", 2.5, 0.0, 945, 100)


@pytest.mark.parametrize(("sub", "grade", "label"), [((9.5, 9.5, 9.5, 9.0), 9.5, None), ((9.5, 9.5, 9.0, 9.0), 9.0, None), ((10.0, 10.0, 10.0, 9.5), 10.0, "Gold"), ((10.0, 10.0, 9.0, 10.0), 9.5, None), ((10.0,) * 4, 10.0, "Black")])
def test_bgs_final(spark, sub, grade, label):
    r = one(spark, scores.bgs_final(F.array(*map(F.lit, sub))).alias("b")).b
    assert (r.grade, r.label) == (grade, label)


def test_recognised_text(spark):
    r = one(
        spark, text.clean_set_number(lit("134/197")).alias("a"), text.clean_set_number(lit("GG44 / gg70")).alias("b"), text.clean_set_number(lit("134")).alias("c"), text.clean_hp(lit("HP 12345")).alias("d"),
        text.clean_card_name(lit(" Pikachu  ex! ")).alias("e"), text.leading_number(lit("12a")).alias("f"), text.leading_int(lit("gg44")).alias("g"), text.card_image_url(lit("base1-4")).alias("h"), text.card_image_url(lit("base1")).alias("i"),
    )
    assert (tuple(r.a), tuple(r.b), tuple(r.c), r.d) == (("134", "197"), ("gg44", "gg70"), ("134", None), 123)
    assert (r.e, r.f, r.g, r.h, r.i) == ("PIKACHU ex", 12.0, None, "https://assets.tcgdex.net/en/base/base1/4/high.png", None)


def test_scans_without_dings_and_without_back(spark):
    scans = spark.createDataFrame([(1, 50.0, 50.0, None, None)], "id long, front_lr double, front_tb double, back_lr double, back_tb double")
    none = spark.createDataFrame([], "scan_id long, side string, type string, severity double")
    r = {x.company: x for x in grading.grade_scans(scans, none).collect()}
    assert r["tag"].condition == 990 and r["tag"].grade == 10 and len(r) == 5
    defects = spark.createDataFrame([(1, "front", "SURFACE_CREASE", 5, 0.9)], "scan_id long, side string, type string, severity int, confidence double")
    flat = scans.selectExpr("id", "50.0D front_offset", "cast(null as double) back_offset")
    loose, strict = (grading.tag_scores(flat, defects, strict_side=s).first() for s in (False, True))
    assert loose.back_score == 990 and loose.condition == 590 and strict.condition == 590
    light = defects.withColumn("severity", F.lit(1))
    assert [grading.tag_scores(flat, light, strict_side=s).first().condition for s in (False, True)] == [990 - 202, 990 - 135]


def test_hamming_bands_equal_brute_force(spark):
    import random

    r = random.Random(6)
    hashes = [r.getrandbits(64) & ~1 for _ in range(60)]
    hashes += [h ^ sum(1 << r.randrange(1, 64) for _ in range(r.randrange(12))) for h in hashes]
    hashes = [h & ~1 & (2**64 - 1) for h in hashes]
    df = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(hashes)], "id long, hash string")
    got = {tuple(x) for x in similarity.hamming_within(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "card_id")).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if (x ^ y).bit_count() <= 8}
    assert got == want
    with pytest.raises(Exception, match="16-digit"):
        df.select(similarity.hash_halves(F.lit("abc"))[0]).collect()


def test_cosine_of_zero_vectors_and_large_galleries(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(40, 8)))] + [(99, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q, g = df.withColumnRenamed("id", "query_id"), df.select(F.col("id").cast("string").alias("card_id"), "embedding")
    near = [tuple(x) for x in similarity.cosine_topk(q, g, 3).select("query_id", "card_id", "rank").orderBy("query_id", "rank").collect()]
    assert len(near) == 120 and all(str(a) == b for a, b, k in near if k == 1)
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    assert [tuple(x) for x in similarity.cosine_topk(q, g, 3).select("query_id", "card_id", "rank").orderBy("query_id", "rank").collect()] == near


def test_hamming_topn_in_blocks_equals_brute_force(spark, monkeypatch):
    import random

    r = random.Random(9)
    hashes = [r.getrandbits(64) for _ in range(90)] + [0, 0, 0]  # the last three tie
    df = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(hashes)], "id long, hash string")
    q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "card_id")
    want = {(a, b, d, k) for a, x in enumerate(hashes) for k, (d, b) in enumerate(sorted(((x ^ y).bit_count(), b) for b, y in enumerate(hashes))[:4], 1)}
    for block, most in ((4096, 256_000_000), (16, 0)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "BROADCAST_BYTES", most)
        top = similarity.hamming_topn(q, c, 4)
        assert {tuple(x) for x in top.select("query_id", "card_id", "distance", "rank").collect()} == want
        plan = top._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Join Cross")  # the n best leave a block, not Q x N rows
    assert similarity.hamming_topn(q, c.where("card_id < 0"), 4).count() == 0


def test_cosine_pairs_sends_no_side_whole_by_itself(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    pairs = similarity.cosine_pairs(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "card_id"))
    assert "ResolvedHint" not in (plan := pairs._jdf.queryExecution().analyzed().toString()) and "broadcast" not in plan
    assert pairs.count() == 4


def test_search_runs_every_branch_of_the_score(spark, sf):
    from cardloom.plans import QUERIES

    found = {}
    for r in QUERIES["j11_search_cards_all_fields"](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.match_score)
    scores = set().union(*found.values())
    assert 70 in found[120]  # ' holo' holds the card's name, and the number is equal
    assert max(found[80]) >= 100 and {100, 130} <= scores  # upper case is the exact name; set total
    assert {50, 70} <= found[100]  # hp


def test_calibration_equals_the_fold(spark):
    from cardloom.streaming.jobs import fold_mean

    for n in (1, 2, 5, 6, 7, 20):
        values = [[float((7 * k * k) % 13)] for k in range(n)]
        df = spark.createDataFrame([(1, "std", k, v[0]) for k, v in enumerate(values)], "device long, kind string, event_id long, x double")
        row = sequences.calibrate_bounds(df, ["x"]).first()
        count, mean = fold_mean(0, [], values)
        assert row["count"] == count and row.x == pytest.approx(mean[0])


def test_wildcards_in_search_terms(spark):
    scans = spark.createDataFrame([(1, 7, "Red Ring"), (2, 7, "Blue"), (3, 8, "Red")], "id long, user_id long, card_name string")
    terms = spark.createDataFrame([(7, "r_d"), (8, "%")], "user_id long, term string")
    assert {r.id for r in collection.search_scans(scans, terms).collect()} == {1, 3}


def test_cards_of_a_term_are_ranked_once_for_all_its_queries(spark, monkeypatch):
    from cardloom.operators import search

    monkeypatch.setattr(search, "TOGETHER", 7, raising=False)
    cards = [(f"c{k}", "s", str(k), ("Red Ring", "red bolt", "Blue", None)[k % 4], 10, 70, k) for k in range(400)]
    catalog = spark.createDataFrame(cards, "card_id string, set_id string, local_id string, name string, hp long, set_total long, ord long")
    asked = [(k, ("RED", "blue", " ring", "re", None)[k % 5]) for k in range(100)]
    hits = search.name_hits(spark.createDataFrame(asked, "query_id long, name string"), catalog)
    assert not any("Window [" in line and "query_id" in line for line in hits._jdf.queryExecution().executedPlan().toString().split("\n"))
    want = [(q, c[0]) for q, name in asked if name and len(name) >= 3 for c in [c for c in cards if c[3] and name.strip().lower() in c[3].lower()][:50]]
    assert sorted((r.query_id, r.card_id) for r in hits.collect()) == sorted(want)


def test_population_joins_scans_once(spark, sf):
    from cardloom.plans import QUERIES

    plan = QUERIES["a15_population"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey") and plan.count("Relation [o_orderkey") == 1
