"""Queries over scores and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales, scores
from ..operators import grading as g
from .base import Inputs, query


def values(rows) -> str:
    def one(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# Fixed values, written out for the SQL so that it does not depend on the library's tables: least score, most score, grade and label
# of each company's bands, best first.
BAND_ROWS = {
    "tag": """990 1000 10 Pristine|950 989 10 Gem Mint|900 949 9 Mint|850 899 8.5 NM-MT+|800 849 8 NM-MT|750 799 7.5 NM+|700 749 7 NM|650 699 6.5 EX-MT+
      |600 649 6 EX-MT|550 599 5.5 EX+|500 549 5 EX|450 499 4.5 VG-EX+|400 449 4 VG-EX|350 399 3.5 VG+|300 349 3 VG|250 299 2.5 Good+|200 249 2 Good|150 199 1.5 Fair|100 149 1 Poor""",
    "psa": "950 1000 10 Gem Mint|850 949 9 Mint|750 849 8 NM-MT|650 749 7 NM|550 649 6 EX-MT|450 549 5 EX|350 449 4 VG-EX|250 349 3 VG|150 249 2 Good|100 149 1 Poor",
    "bgs": """990 1000 10 Pristine|975 989 10 Perfect|925 974 9.5 Gem Mint|875 924 9 Mint|825 874 8.5 NM-MT+|775 824 8 NM-MT|725 774 7.5 NM+|675 724 7 NM
      |625 674 6.5 EX-MT+|575 624 6 EX-MT|525 574 5.5 EX+|475 524 5 EX|375 474 4 VG-EX|275 374 3 VG|175 274 2 Good|100 174 1 Poor""",
    "cgc": """985 1000 10 Pristine|940 984 9.5 Gem Mint|890 939 9 Mint|840 889 8.5 NM-MT+|790 839 8 NM-MT|740 789 7.5 NM+|690 739 7 NM|640 689 6.5 EX-MT+
      |590 639 6 EX-MT|540 589 5.5 EX+|490 539 5 EX|390 489 4 VG-EX|290 389 3 VG|190 289 2 Good|100 189 1 Poor""",
    "sgc": """960 1000 10 Pristine|920 959 10 Gem Mint|880 919 9.5 Mint+|840 879 9 Mint|800 839 8.5 NM-MT+|760 799 8 NM-MT|720 759 7.5 NM+|680 719 7 NM
      |600 679 6 EX-MT|500 599 5 EX|400 499 4 VG-EX|300 399 3 VG|200 299 2 Good|100 199 1 Poor""",
}
# grade=most offset, by company and side; tag's two limits for a 10 stand apart in the client's ladder.
LIMIT_ROWS = {
    ("tag", "front"): "9=60 8.5=62.5 8=65 7.5=67.5 7=70 6.5=72.5 6=75 5.5=77.5 5=80 4.5=82.5 4=85 3.5=87.5 3=90 2.5=92.5 2=95 1.5=98.33",
    ("tag", "back"): "9=75 8=85",
    ("psa", "front"): "10=60 9=65 8=70 7=75 6=80 5=85 4=90",
    ("psa", "back"): "10=75 9=80 8=90",
    ("bgs", "front"): "10=50 9.5=55 9=60 8.5=65 8=70 7.5=75 7=80 6=85 5=90",
    ("bgs", "back"): "10=55 9.5=60 9=70 8=80",
    ("cgc", "front"): "10=55 9.5=60 9=65 8.5=70 8=75 7=80 6=85 5=90",
    ("cgc", "back"): "10=60 9.5=65 9=75 8=85",
    ("sgc", "front"): "10=60 9=65 8=70 7=75 6=80 5=90",
    ("sgc", "back"): "10=75 9=80 8=90",
}
# Most offset=subgrade score of the client.
LADDER_ROWS = {
    ("tag", "front"): "51=995 55=970 60=920 62.5=875 65=825 67.5=775 70=725 72.5=675 75=625 77.5=575 80=525 85=425",
    ("tag", "back"): "52=995 65=970 75=920 85=825",
    ("psa", "front"): "60=970 65=920 70=825 75=725 80=625 85=525 90=425",
    ("psa", "back"): "75=970 80=920 90=825",
    ("bgs", "front"): "50=970 55=945 60=920 65=875 70=825 75=775 80=725 85=625 90=525",
    ("bgs", "back"): "55=970 60=945 70=920 80=825",
    ("cgc", "front"): "55=970 60=945 65=920 70=875 75=825 80=725 85=625 90=525",
    ("cgc", "back"): "60=970 65=945 75=920 85=825",
    ("sgc", "front"): "60=970 65=920 70=825 75=725 80=625 90=525",
    ("sgc", "back"): "75=970 80=920 90=825",
}
# Most offset=subgrade score of the scorer.
TAG_ROWS = {
    ("tcg", "front"): "52=995 55=970 60=920 62.5=860 65=825 67.5=775 70=725 72.5=675 75=625 80=525",
    ("tcg", "back"): "52=995 65=970 75=920 85=825",
    ("sports", "front"): "51=995 55=970 57=920 62.5=860 65=825 67.5=775 70=725 75=625 80=525 90=350",
    ("sports", "back"): "54.5=995 70=970 75=920 95=700",
}
# Points for severity 1 to 5.
DEDUCTION_ROWS = {
    "CORNER_WHITENING": "30 60 100 150 200", "CORNER_SOFT": "20 50 80 120 180", "CORNER_FRAYING": "40 80 130 180 250",
    "EDGE_DAMAGE": "25 50 90 140 200", "EDGE_WHITENING": "30 60 100 150 200", "EDGE_CHIPPING": "35 70 120 170 230",
    "SURFACE_SCRATCH": "40 80 140 200 300", "SURFACE_STAIN": "50 100 160 220 320", "PRINT_LINE": "20 40 70 100 150", "SURFACE_CREASE": "150 250 350 450 550",
}


def pairs(rows: dict, kind=float):
    """The keys and both numbers of each x=y."""
    return ((*key, float(x), kind(y)) for key, text in rows.items() for x, y in (p.split("=") for p in text.split()))


def band_rows():
    for company, text in BAND_ROWS.items():
        for k, band in enumerate(text.split("|")):
            lo, hi, grade, label = band.split(maxsplit=3)
            yield company, k, float(grade), label.strip(), int(lo), int(hi)


BANDS = f"bands(company, ord, grade, label, lo, hi) AS (VALUES {values(band_rows())})"
LIMITS = f"limits(company, side, grade, most) AS (VALUES {values(pairs(LIMIT_ROWS))})"
COMPANIES = "companies(company) AS (VALUES ('tag'), ('psa'), ('bgs'), ('cgc'), ('sgc'))"
LADDER = f"ladder(company, side, most, points) AS (VALUES {values(pairs(LADDER_ROWS, int))})"
TAG = f"tagladder(card_type, side, most, points) AS (VALUES {values(pairs(TAG_ROWS, int))})"
DEDUCT = f"deductions(type, severity, points) AS (VALUES {values((k, s, int(p)) for k, row in DEDUCTION_ROWS.items() for s, p in enumerate(row.split(), start=1))})"

OFFSETS = """offs AS (SELECT id AS scan_id, greatest(coalesce(front_lr, 50.0::DOUBLE), 100 - coalesce(front_lr, 50.0::DOUBLE), coalesce(front_tb, 50.0::DOUBLE), 100 - coalesce(front_tb, 50.0::DOUBLE)) AS front_offset,
  greatest(coalesce(back_lr, 50.0::DOUBLE), 100 - coalesce(back_lr, 50.0::DOUBLE), coalesce(back_tb, 50.0::DOUBLE), 100 - coalesce(back_tb, 50.0::DOUBLE)) AS back_offset FROM {scans})"""
CONDITION = """cond AS (SELECT scan_id, greatest(300::DOUBLE, 990 - sum(w * CASE WHEN type = 'CENTERING' THEN 0 WHEN type LIKE '%SURFACE%' THEN 40 + s * 15 WHEN type LIKE '%CORNER%' THEN 25 + s * 10
    WHEN type LIKE '%EDGE%' THEN 20 + s * 8 ELSE 20 END)) AS condition, count(*) AS total_dings, floor(sum(s * w) * 10 + 0.5::DOUBLE) / 10 AS weighted
  FROM (SELECT *, coalesce(nullif(severity, 0), 1) AS s, CASE WHEN side = 'FRONT' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM {dings}) GROUP BY scan_id)"""
GRADED = f"""{BANDS}, {LADDER}, {COMPANIES}, {OFFSETS}, {CONDITION},
each AS (SELECT o.*, c.company, coalesce(condition, 990::DOUBLE) AS condition, coalesce(total_dings, 0) AS total_dings, coalesce(weighted, 0::DOUBLE) AS weighted FROM offs o CROSS JOIN companies c LEFT JOIN cond USING (scan_id)),
scored AS (SELECT e.*, coalesce((SELECT max(points) FROM ladder l WHERE l.company = e.company AND l.side = 'front' AND e.front_offset <= l.most), 350) AS front_score,
  coalesce((SELECT max(points) FROM ladder l WHERE l.company = e.company AND l.side = 'back' AND e.back_offset <= l.most), 700) AS back_score FROM each e),
raw AS (SELECT *, CAST(greatest(300, least(1000, floor(least(front_score, back_score, condition) * 0.75::DOUBLE + (front_score + back_score + condition) / 3.0::DOUBLE * 0.25::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS raw_score FROM scored),
graded AS (SELECT r.*, coalesce(b.grade, 1.0::DOUBLE) AS grade, coalesce(b.label, 'Poor') AS label FROM raw r LEFT JOIN bands b ON b.company = r.company AND r.raw_score BETWEEN b.lo AND b.hi)"""


def graded(f: Inputs):
    return g.grade_scans(f.scans, f.dings)


@query(
    "f46_grade_distribution",
    f"WITH {GRADED} SELECT company, grade, label, count(*) AS scans, CAST(sum(raw_score) AS BIGINT) AS score_sum, CAST(sum(total_dings) AS BIGINT) AS dings FROM graded GROUP BY ALL",
)
def _(f):
    return graded(f).groupBy("company", "grade", "label").agg(
        F.count(F.lit(1)).alias("scans"), F.sum(F.col("raw_score").cast("long")).alias("score_sum"), F.sum("total_dings").alias("dings")
    )


@query(
    "f46_j5_a1_f31_j2_grades",
    f"WITH {GRADED} SELECT scan_id, company, front_offset, back_offset, CAST(front_score AS BIGINT) AS front_score, CAST(back_score AS BIGINT) AS back_score, condition, raw_score, grade, label, CAST(total_dings AS BIGINT) AS total_dings, weighted FROM graded",
)
def _(f):
    long = ("front_score", "back_score", "raw_score", "total_dings")
    return graded(f).withColumns({c: F.col(c).cast("long") for c in long}).select(
        "scan_id", "company", "front_offset", "back_offset", "front_score", "back_score", "condition", "raw_score", "grade", "label", "total_dings", "weighted"
    )


@query("a1_a3_condition_and_totals", f"WITH {CONDITION} SELECT scan_id, condition, CAST(total_dings AS BIGINT) AS total_dings, weighted FROM cond")
def _(f):
    return g.condition_of_dings(f.dings)


@query(
    "a4_ding_breakdown",
    """SELECT scan_id, count(*) FILTER (side = 'FRONT') AS front, count(*) FILTER (side = 'BACK') AS back, count(*) FILTER (type LIKE '%SURFACE%') AS surface, count(*) FILTER (type LIKE '%CORNER%') AS corner,
    count(*) FILTER (type LIKE '%EDGE%') AS edge, count(*) FILTER (type = 'CENTERING') AS centering, count(*) AS total FROM {dings} GROUP BY scan_id""",
)
def _(f):
    return g.ding_breakdown(f.dings)


@query(
    "j2_grade_bands",
    f"""WITH {BANDS}, {COMPANIES} SELECT s.id, c.company, coalesce(b.grade, 1.0::DOUBLE) AS grade, coalesce(b.label, 'Poor') AS label
    FROM (SELECT id, raw_score + CASE WHEN id % 10 = 0 THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN id % 17 = 0 THEN 100 ELSE 0 END AS score FROM {{scans}}) s CROSS JOIN companies c
    LEFT JOIN bands b ON b.company = c.company AND s.score BETWEEN b.lo AND b.hi""",
)
def _(f):
    score = F.col("raw_score") + F.when(F.col("id") % 10 == 0, 0.5).otherwise(0.0) - F.when(F.col("id") % 17 == 0, 100).otherwise(0)
    each = f.scans.select("id", score.alias("score"), F.explode(F.array(*map(F.lit, scales.COMPANIES))).alias("company"))
    return each.withColumn("b", scales.grade_from_score(F.col("score"), F.col("company"))).select("id", "company", "b.grade", "b.label")


@query(
    "j3_centering_grade",
    f"""WITH {LIMITS} SELECT id, company, coalesce((SELECT max(grade) FROM limits l WHERE l.company = s.company AND l.side = 'front' AND s.front_lr <= l.most), 1.0::DOUBLE) AS front_grade,
    coalesce((SELECT max(grade) FROM limits l WHERE l.company = s.company AND l.side = 'back' AND s.back_lr <= l.most), 1.0::DOUBLE) AS back_grade FROM {{scans}} s""",
)
def _(f):
    c = F.col("company")
    return f.scans.select("id", "company", scales.centering_grade(F.col("front_lr"), "front", c).alias("front_grade"), scales.centering_grade(F.col("back_lr"), "back", c).alias("back_grade"))


@query(
    "j4_tag_centering_score",
    f"""WITH {TAG} SELECT id, CASE WHEN id % 2 = 0 THEN 'sports' ELSE 'tcg' END AS card_type,
    CAST(coalesce((SELECT max(points) FROM tagladder l WHERE l.card_type = CASE WHEN id % 2 = 0 THEN 'sports' ELSE 'tcg' END AND l.side = 'front' AND s.front_lr <= l.most), 400) AS BIGINT) AS front_score,
    CAST(coalesce((SELECT max(points) FROM tagladder l WHERE l.card_type = CASE WHEN id % 2 = 0 THEN 'sports' ELSE 'tcg' END AND l.side = 'back' AND s.back_lr <= l.most), 400) AS BIGINT) AS back_score FROM {{scans}} s""",
)
def _(f):
    kind = F.when(F.col("id") % 2 == 0, "sports").otherwise("tcg")
    return f.scans.withColumn("card_type", kind).select(
        "id", "card_type", *(scales.tag_centering_score(F.col(f"{s}_lr"), s, F.col("card_type")).cast("long").alias(f"{s}_score") for s in ("front", "back"))
    )


TAG_SCORED = f"""{TAG}, {DEDUCT}, {BANDS},
pts AS (SELECT scan_id, sum(CAST(trunc(CAST(trunc(coalesce(p.points, 30) * confidence) AS DOUBLE) * CASE WHEN upper(side) = 'FRONT' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT)) AS points
  FROM {{defects}} d LEFT JOIN deductions p USING (type, severity) WHERE confidence >= 0.75::DOUBLE GROUP BY scan_id),
base AS (SELECT id AS scan_id, greatest(front_lr, 100 - front_lr, front_tb, 100 - front_tb) AS front_offset, greatest(back_lr, 100 - back_lr, back_tb, 100 - back_tb) AS back_offset FROM {{scans}}),
sub AS (SELECT b.*, coalesce((SELECT max(points) FROM tagladder l WHERE l.card_type = 'tcg' AND l.side = 'front' AND b.front_offset <= l.most), 400) AS front_score,
  CASE WHEN back_offset IS NULL THEN 990 ELSE coalesce((SELECT max(points) FROM tagladder l WHERE l.card_type = 'tcg' AND l.side = 'back' AND b.back_offset <= l.most), 400) END AS back_score,
  greatest(500, 990 - least(400, coalesce(points, 0))) AS condition FROM base b LEFT JOIN pts USING (scan_id)),
tagged AS (SELECT *, CAST(greatest(100, least(1000, trunc(least(front_score, back_score, condition) * 0.75::DOUBLE + (front_score + back_score + condition) / 3.0::DOUBLE * 0.25::DOUBLE))) AS BIGINT) AS tag_score FROM sub),
tagscored AS (SELECT t.*, coalesce((SELECT max(grade) FROM bands b WHERE b.company = 'tag' AND t.tag_score >= b.lo), 1.0::DOUBLE) AS grade,
  coalesce((SELECT arg_min(label, ord) FROM bands b WHERE b.company = 'tag' AND t.tag_score >= b.lo), 'Poor') AS label FROM tagged t)"""


def offsets(f: Inputs):
    return f.scans.select("id", scores.max_offset(F.col("front_lr"), F.col("front_tb")).alias("front_offset"), F.when(F.col("back_lr").isNotNull(), scores.max_offset(F.col("back_lr"), F.col("back_tb"))).alias("back_offset"))


def tag_scored(f: Inputs):
    return g.tag_scores(offsets(f), f.defects)


@query(
    "j6_a2_f32_f33_tag_scores",
    f"WITH {TAG_SCORED} SELECT scan_id, front_offset, back_offset, CAST(front_score AS BIGINT) AS front_score, CAST(back_score AS BIGINT) AS back_score, CAST(condition AS BIGINT) AS condition, tag_score, grade, label FROM tagscored",
)
def _(f):
    return tag_scored(f).withColumns({c: F.col(c).cast("long") for c in ("front_score", "back_score", "condition", "tag_score")})


@query(
    "f34_u4_backend_dings",
    f"""WITH {TAG_SCORED}, low AS (SELECT *, least(front_score, back_score, condition) AS m FROM tagscored),
    alld AS (SELECT scan_id, 'CENTERING' AS type, 'FRONT' AS location FROM low WHERE front_score = m AND front_score < 970 UNION ALL SELECT scan_id, 'CENTERING', 'BACK' FROM low WHERE back_score = m AND back_score < 970
    UNION ALL SELECT scan_id, type, side || '_' || location FROM {{defects}} WHERE severity >= 2) SELECT scan_id, type, location, count(*) AS n FROM alld GROUP BY ALL""",
)
def _(f):
    return g.backend_dings(tag_scored(f), f.defects).groupBy("scan_id", "type", "location").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f42_backend_to_client",
    f"""WITH {TAG_SCORED} SELECT scan_id, side, type, severity, deduction, count(*) AS n FROM (SELECT scan_id, upper(side) AS side, type, CAST(severity AS BIGINT) AS severity, CAST(severity * 20 AS BIGINT) AS deduction FROM {{defects}}
    UNION ALL SELECT scan_id, 'FRONT', 'CENTERING', CASE WHEN front_score < 900 THEN 3 WHEN front_score < 950 THEN 2 ELSE 1 END, CAST(990 - front_score AS BIGINT) FROM tagscored WHERE front_score < 970
    UNION ALL SELECT scan_id, 'BACK', 'CENTERING', CASE WHEN back_score < 900 THEN 3 WHEN back_score < 950 THEN 2 ELSE 1 END, CAST(990 - back_score AS BIGINT) FROM tagscored WHERE back_score < 970) GROUP BY ALL""",
)
def _(f):
    return g.backend_to_client(tag_scored(f), f.defects).groupBy("scan_id", "side", "type", "severity", "deduction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f35_company_grades",
    f"""WITH {TAG_SCORED}, {COMPANIES}, b AS (SELECT scan_id, company, tag_score, grade, front_offset AS f, coalesce(back_offset, 50) AS k FROM tagscored CROSS JOIN companies),
    c AS (SELECT *, CASE company WHEN 'psa' THEN CASE WHEN NOT (f <= 55 AND k <= 75) AND grade = 10 THEN 9.0::DOUBLE ELSE grade END
      WHEN 'bgs' THEN least(grade, 0.5::DOUBLE + CASE WHEN f <= 50 AND k <= 50 THEN 10.0::DOUBLE WHEN f <= 55 AND k <= 60 THEN 9.5::DOUBLE WHEN f <= 60 AND k <= 65 THEN 9.0::DOUBLE WHEN f <= 65 AND k <= 75 THEN 8.0::DOUBLE ELSE 7.0::DOUBLE END)
      WHEN 'sgc' THEN CASE WHEN grade = 10 AND NOT (f <= 50 AND k <= 50 AND tag_score >= 990) AND NOT (f <= 55 AND k <= 70 AND tag_score >= 950) THEN 9.5::DOUBLE ELSE grade END ELSE grade END AS g FROM b)
    SELECT scan_id, company, g AS grade, CASE company WHEN 'psa' THEN f <= 55 AND k <= 75 WHEN 'cgc' THEN f <= 50 AND k <= 50 AND tag_score >= 990 WHEN 'sgc' THEN f <= 50 AND k <= 50 AND tag_score >= 990 END AS ok,
    CASE company WHEN 'psa' THEN 'PSA ' || CASE WHEN g = floor(g) THEN CAST(CAST(g AS BIGINT) AS VARCHAR) ELSE CAST(g AS VARCHAR) END WHEN 'bgs' THEN 'BGS ' || CAST(g AS VARCHAR)
      WHEN 'cgc' THEN 'CGC ' || CAST(g AS VARCHAR) || CASE WHEN g = 10 THEN CASE WHEN f <= 50 AND k <= 50 AND tag_score >= 990 THEN ' Pristine' ELSE ' Gem Mint' END ELSE '' END
      WHEN 'sgc' THEN 'SGC ' || CAST(g AS VARCHAR) || CASE WHEN g = 10 THEN CASE WHEN f <= 50 AND k <= 50 AND tag_score >= 990 THEN ' Pristine' ELSE ' Gem Mint' END ELSE '' END
      ELSE 'TAG ' || CAST(tag_score AS VARCHAR) END AS label FROM c""",
)
def _(f):
    each = tag_scored(f).select("scan_id", "tag_score", "front_offset", "back_offset", F.explode(F.array(*map(F.lit, scales.COMPANIES))).alias("company"))
    graded = scales.with_company_grade(each, F.col("tag_score"), F.col("company"), F.col("front_offset"), F.col("back_offset"))
    return graded.select("scan_id", "company", "grade", "ok", "label")


@query(
    "f35_best_company",
    f"""WITH {TAG_SCORED} SELECT scan_id, CASE WHEN front_offset <= 55 AND coalesce(back_offset, 50) <= 75 THEN true ELSE false END AS psa_ok FROM tagscored""",
)
def _(f):
    c = scales.company_grade(F.col("tag_score"), F.lit("psa"), F.col("front_offset"), F.col("back_offset"))
    return tag_scored(f).select("scan_id", c["ok"].alias("psa_ok"))


@query(
    "f36_convert_grade",
    f"""WITH {COMPANIES} SELECT s.id, c.company AS target, s.grade_value, CASE WHEN c.company IN ('psa', 'sgc') AND grade_value >= 1 AND grade_value <> floor(grade_value) THEN ceil(grade_value) ELSE grade_value END AS converted
    FROM {{scans}} s CROSS JOIN companies c""",
)
def _(f):
    each = f.scans.select("id", "grade_value", F.explode(F.array(*map(F.lit, scales.COMPANIES))).alias("target"))
    return each.withColumn("converted", scales.convert_grade(F.col("grade_value"), F.col("target")))


@query(
    "p10_scoring_and_listed_defects",
    "SELECT scan_id, count(*) FILTER (confidence >= 0.75::DOUBLE) AS scoring, count(*) FILTER (severity >= 2) AS listed FROM {defects} WHERE confidence >= 0.75::DOUBLE OR severity >= 2 GROUP BY scan_id",
)
def _(f):
    both = g.scoring_defects(f.defects).select("scan_id", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(g.listed_defects(f.defects).select("scan_id", F.lit(0).alias("s"), F.lit(1).alias("l")))
    return both.groupBy("scan_id").agg(F.sum("s").alias("scoring"), F.sum("l").alias("listed"))


SIDES = "sides AS (SELECT id AS scan_id, 'FRONT' AS side, front_lr AS lr, front_tb AS tb FROM {scans} WHERE id % 13 <> 0 UNION ALL SELECT id, 'BACK', back_lr, back_tb FROM {scans} WHERE back_lr IS NOT NULL)"


def sides(f: Inputs):
    front = f.scans.where("id % 13 <> 0").select(F.col("id").alias("scan_id"), F.lit("FRONT").alias("side"), F.col("front_lr").alias("lr"), F.col("front_tb").alias("tb"))
    back = f.scans.where("back_lr is not null").select(F.col("id").alias("scan_id"), F.lit("BACK").alias("side"), F.col("back_lr").alias("lr"), F.col("back_tb").alias("tb"))
    return front.unionByName(back)


@query(
    "f28_f29_centering_dings",
    f"""WITH {SIDES} SELECT scan_id, side, 'CENTERING' AS type, greatest(lr, 100 - lr, tb, 100 - tb) - CASE WHEN side = 'FRONT' THEN 55 ELSE 65 END AS severity FROM sides
    WHERE greatest(lr, 100 - lr, tb, 100 - tb) > CASE WHEN side = 'FRONT' THEN 55 ELSE 65 END""",
)
def _(f):
    return g.centering_dings(sides(f))


@query(
    "j13_combine_sides",
    f"""WITH {SIDES}, x AS (SELECT * FROM sides WHERE side = 'FRONT'), y AS (SELECT * FROM sides WHERE side = 'BACK')
    SELECT coalesce(x.scan_id, y.scan_id) AS scan_id, x.scan_id IS NOT NULL AS has_front, y.scan_id IS NOT NULL AS has_back,
    coalesce(greatest(x.lr, 100 - x.lr, x.tb, 100 - x.tb), 50.0::DOUBLE) AS front_offset, greatest(y.lr, 100 - y.lr, y.tb, 100 - y.tb) AS back_offset FROM x FULL OUTER JOIN y ON x.scan_id = y.scan_id""",
)
def _(f):
    return g.combine_sides(sides(f))


@query(
    "f40_result_confidence",
    """WITH x AS (SELECT id, CASE WHEN id % 5 = 0 THEN 50.0::DOUBLE ELSE front_lr END AS fl, CASE WHEN id % 5 = 0 THEN 50.0::DOUBLE ELSE front_tb END AS ft, CASE WHEN id % 7 = 0 THEN 50.0::DOUBLE ELSE back_lr END AS bl,
      CASE WHEN id % 7 = 0 THEN 50.0::DOUBLE ELSE back_tb END AS bt, raw_score, id % 2 = 0 AS fh, id % 3 = 0 AS bh, id % 20 AS an, id % 4 AS sd FROM {scans}),
    y AS (SELECT *, coalesce(fl = 50 AND ft = 50, false) AS a, coalesce(bl = 50 AND bt = 50, false) AS b, len(list_filter([990, 950, 900, 850, 800, 700, 600, 500], lambda q: abs(raw_score - q) < 20)) > 0 AS c, an > 10 AND sd = 0 AS d FROM x),
    z AS (SELECT *, 100 - a::INT * 25 - b::INT * 15 - c::INT * 15 - fh::INT * 10 - bh::INT * 5 - d::INT * 10 AS v FROM y)
    SELECT id, CAST(greatest(0, v) AS BIGINT) AS confidence, CASE WHEN v >= 80 THEN 'HIGH' WHEN v >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS level, CAST(a::INT + b::INT + c::INT + fh::INT + bh::INT + d::INT AS BIGINT) AS reasons FROM z""",
)
def _(f):
    i = F.col("id")
    even = lambda n, c: F.when(i % n == 0, 50.0).otherwise(F.col(c))
    r = scores.result_confidence(even(5, "front_lr"), even(5, "front_tb"), even(7, "back_lr"), even(7, "back_tb"), F.col("raw_score"), i % 2 == 0, i % 3 == 0, i % 20, i % 4)
    return f.scans.select("id", r.alias("r")).select("id", F.col("r.confidence").cast("long").alias("confidence"), "r.level", F.size("r.reasons").cast("long").alias("reasons"))


@query(
    "f41_next_grade_tips",
    """WITH b AS (SELECT scan_id, count(*) AS total, count(*) FILTER (side = 'FRONT') AS front, count(*) FILTER (type LIKE '%SURFACE%') AS surface, count(*) FILTER (type = 'CENTERING') AS centering FROM {dings} GROUP BY scan_id)
    SELECT scan_id, coalesce(array_to_string(CASE WHEN raw_score >= 950 THEN ['gem_mint_range'] WHEN raw_score >= 900 THEN [CASE WHEN centering > 0 THEN 'centering_only' END, CASE WHEN total <= 1 THEN 'one_ding_from_gem_mint' END]
      WHEN raw_score >= 800 THEN [CASE WHEN front > 0 THEN 'front_dings:' || front END, CASE WHEN surface > 0 THEN 'surface_is_heaviest' END, 'reduce_total:' || total]
      WHEN raw_score >= 700 THEN [CASE WHEN front >= 2 THEN 'several_front_dings' END, 'fewer_needed:' || greatest(0, total - 4)]
      WHEN raw_score >= 600 THEN ['front_wear_pattern:' || total, CASE WHEN surface > 0 THEN 'play_wear_limits' END]
      ELSE ['heavy_load:' || total, CASE WHEN surface >= 2 THEN 'wear_on_both_sides' END] END, ';'), '') AS tips FROM b JOIN {scans} s ON s.id = b.scan_id""",
)
def _(f):
    rows = g.ding_breakdown(f.dings).join(f.scans.select(F.col("id").alias("scan_id"), "raw_score"), "scan_id")
    return rows.select("scan_id", F.array_join(scores.next_grade_tips(F.col("raw_score"), F.col("total"), F.col("front"), F.col("surface"), F.col("centering")), ";").alias("tips"))


@query(
    "f30_effective_centering",
    """WITH x AS (SELECT id, id % 10 = 0 AS ign, CASE WHEN id % 4 = 0 THEN front_tb END AS m, id % 4 = 0 AS hm, CASE WHEN id % 8 = 0 THEN back_tb END AS bm, CASE WHEN id % 3 = 0 THEN 45.5::DOUBLE END AS ai, id % 2 = 0 AS use_ai, front_lr, coalesce(back_lr, 50) AS back_lr FROM {scans})
    SELECT id, CASE WHEN ign THEN 50.0::DOUBLE WHEN hm THEN m WHEN use_ai AND ai IS NOT NULL THEN ai ELSE front_lr END AS front, CASE WHEN ign THEN 50.0::DOUBLE WHEN hm THEN coalesce(bm, back_lr) WHEN use_ai AND ai IS NOT NULL THEN ai ELSE back_lr END AS back FROM x""",
)
def _(f):
    i = F.col("id")
    pair = lambda v: F.struct(v.alias("lr"), v.alias("tb"))
    ai = F.when(i % 3 == 0, pair(F.lit(45.5)))
    common = (i % 10 == 0,)
    hm = i % 4 == 0
    front = scores.effective_centering(*common, F.when(hm, pair(F.col("front_tb"))), hm, ai, i % 2 == 0, pair(F.col("front_lr")))
    back = scores.effective_centering(*common, F.when((i % 8 == 0) & F.col("back_tb").isNotNull(), pair(F.col("back_tb"))), hm, ai, i % 2 == 0, pair(F.coalesce("back_lr", F.lit(50.0))))
    return f.scans.select("id", front["lr"].alias("front"), back["lr"].alias("back"))


@query(
    "f45_bgs_final",
    """WITH x AS (SELECT id, [CAST(6 + id % 9 AS DOUBLE) / 2 + 3, CAST(6 + (id // 3) % 9 AS DOUBLE) / 2 + 3, CAST(6 + (id // 7) % 9 AS DOUBLE) / 2 + 3, CAST(6 + (id // 11) % 9 AS DOUBLE) / 2 + 3] AS s FROM {scans}),
    y AS (SELECT *, list_min(s) AS low, len(list_filter(s, lambda v: v = list_min(s))) AS n, len(list_filter(s, lambda v: v = 10)) AS tens FROM x)
    SELECT id, CASE WHEN n >= 2 THEN low ELSE least(low + 0.5::DOUBLE, 10) END AS grade, CASE WHEN tens = 4 THEN 'Black' WHEN tens = 3 AND low = 9.5::DOUBLE THEN 'Gold' END AS label FROM y""",
)
def _(f):
    s = F.array(*((6 + F.floor(F.col("id") / d) % 9).cast("double") / 2 + 3 for d in (1, 3, 7, 11)))
    return f.scans.select("id", scores.bgs_final(s).alias("b")).select("id", "b.grade", "b.label")


CAPS = [("SURFACE_CREASE", 6.0), ("CORNER_FRAYING", 5.0), ("EDGE_CHIPPING", 8.0), ("SURFACE_SCRATCH", 8.5), ("SURFACE_STAIN", 4.5)]


@query(
    "f53_capped_grade",
    f"""WITH caps(type, cap) AS (VALUES {values(CAPS)}), m AS (SELECT scan_id, min(cap) AS cap FROM {{defects}} JOIN caps USING (type) GROUP BY scan_id)
    SELECT id, least(list_min([grade_value, CAST(raw_score AS DOUBLE) / 100, 9.5::DOUBLE]), coalesce(cap, 10)) AS grade FROM {{scans}} s LEFT JOIN m ON m.scan_id = s.id""",
)
def _(f):
    caps = f.spark.createDataFrame(CAPS, "type string, cap double")
    least = f.defects.join(F.broadcast(caps), "type").groupBy(F.col("scan_id").alias("id")).agg(F.collect_set("cap").alias("caps"))
    rows = f.scans.join(least, "id", "left")
    return rows.select("id", scores.capped_grade(F.array(F.col("grade_value"), F.col("raw_score") / 100, F.lit(9.5)), F.coalesce("caps", F.array(F.lit(10.0)))).alias("grade"))


@query(
    "f54_compound_subgrades",
    "SELECT id, list_min(s) * 0.75::DOUBLE + list_sum(s) / len(s) * 0.25::DOUBLE AS compound FROM (SELECT id, [CAST(raw_score AS DOUBLE), 990 - CAST(id % 300 AS DOUBLE), front_lr * 10, front_tb * 10] AS s FROM {scans})",
)
def _(f):
    s = F.array(F.col("raw_score").cast("double"), 990 - (F.col("id") % 300).cast("double"), F.col("front_lr") * 10, F.col("front_tb") * 10)
    return f.scans.select("id", scores.compound_subgrades(s).alias("compound"))


@query(
    "a15_population",
    f"WITH {GRADED} SELECT card_id, company, grade, count(*) AS scans FROM (SELECT s.card_id, g.company, g.grade FROM graded g JOIN {{scans}} s ON s.id = g.scan_id) GROUP BY ALL",
)
def _(f):
    return g.population(g.grade_scans(f.scans, f.dings, keep=("card_id",)))


@query("w8_leaderboard", "SELECT card_id, id, raw_score, CAST(rank() OVER (PARTITION BY card_id ORDER BY raw_score DESC) AS BIGINT) AS rank FROM {scans}")
def _(f):
    return g.leaderboard(f.scans.select("card_id", "id", "raw_score"))


@query(
    "a13_a14_array_statistics",
    """SELECT id, CASE WHEN len(x) = 0 THEN 0 ELSE list_aggregate(x, 'median') END AS median, CASE WHEN len(x) = 0 THEN 0 ELSE floor(list_aggregate(x, 'stddev_pop') * 1000000 + 0.5::DOUBLE) / 1000000 END AS stdev
    FROM (SELECT id, CASE WHEN id % 10 = 0 THEN CAST([] AS DOUBLE[]) WHEN id % 2 = 0 THEN [front_lr, front_tb, grade_value] ELSE [front_lr, front_tb, grade_value, CAST(id % 7 AS DOUBLE)] END AS x FROM {scans})""",
)
def _(f):
    three = F.array("front_lr", "front_tb", "grade_value")
    x = F.when(F.col("id") % 10 == 0, F.array().cast("array<double>")).when(F.col("id") % 2 == 0, three).otherwise(F.concat(three, F.array((F.col("id") % 7).cast("double"))))
    return f.scans.select("id", scores.array_median(x).alias("median"), scores.half_up(scores.array_stdev(x), 6).alias("stdev"))
