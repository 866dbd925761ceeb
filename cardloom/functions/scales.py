"""Grade scales of five companies, as data, and the functions that look scores and offsets up in them.

Look-ups are generated `when` chains or constant maps, without a join; with_grade alone joins the broadcast bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANIES = ("tag", "psa", "bgs", "cgc", "sgc")

# Fixed values: (grade, label, least score, most score) of each company, best first.
BANDS: dict[str, list[tuple[float, str, int, int]]] = {
    "tag": [
        (10.0, "Pristine", 990, 1000), (10.0, "Gem Mint", 950, 989), (9.0, "Mint", 900, 949), (8.5, "NM-MT+", 850, 899),
        (8.0, "NM-MT", 800, 849), (7.5, "NM+", 750, 799), (7.0, "NM", 700, 749), (6.5, "EX-MT+", 650, 699),
        (6.0, "EX-MT", 600, 649), (5.5, "EX+", 550, 599), (5.0, "EX", 500, 549), (4.5, "VG-EX+", 450, 499),
        (4.0, "VG-EX", 400, 449), (3.5, "VG+", 350, 399), (3.0, "VG", 300, 349), (2.5, "Good+", 250, 299),
        (2.0, "Good", 200, 249), (1.5, "Fair", 150, 199), (1.0, "Poor", 100, 149),
    ],
    "psa": [
        (10.0, "Gem Mint", 950, 1000), (9.0, "Mint", 850, 949), (8.0, "NM-MT", 750, 849), (7.0, "NM", 650, 749),
        (6.0, "EX-MT", 550, 649), (5.0, "EX", 450, 549), (4.0, "VG-EX", 350, 449), (3.0, "VG", 250, 349),
        (2.0, "Good", 150, 249), (1.0, "Poor", 100, 149),
    ],
    "bgs": [
        (10.0, "Pristine", 990, 1000), (10.0, "Perfect", 975, 989), (9.5, "Gem Mint", 925, 974), (9.0, "Mint", 875, 924),
        (8.5, "NM-MT+", 825, 874), (8.0, "NM-MT", 775, 824), (7.5, "NM+", 725, 774), (7.0, "NM", 675, 724),
        (6.5, "EX-MT+", 625, 674), (6.0, "EX-MT", 575, 624), (5.5, "EX+", 525, 574), (5.0, "EX", 475, 524),
        (4.0, "VG-EX", 375, 474), (3.0, "VG", 275, 374), (2.0, "Good", 175, 274), (1.0, "Poor", 100, 174),
    ],
    "cgc": [
        (10.0, "Pristine", 985, 1000), (9.5, "Gem Mint", 940, 984), (9.0, "Mint", 890, 939), (8.5, "NM-MT+", 840, 889),
        (8.0, "NM-MT", 790, 839), (7.5, "NM+", 740, 789), (7.0, "NM", 690, 739), (6.5, "EX-MT+", 640, 689),
        (6.0, "EX-MT", 590, 639), (5.5, "EX+", 540, 589), (5.0, "EX", 490, 539), (4.0, "VG-EX", 390, 489),
        (3.0, "VG", 290, 389), (2.0, "Good", 190, 289), (1.0, "Poor", 100, 189),
    ],
    "sgc": [
        (10.0, "Pristine", 960, 1000), (10.0, "Gem Mint", 920, 959), (9.5, "Mint+", 880, 919), (9.0, "Mint", 840, 879),
        (8.5, "NM-MT+", 800, 839), (8.0, "NM-MT", 760, 799), (7.5, "NM+", 720, 759), (7.0, "NM", 680, 719),
        (6.0, "EX-MT", 600, 679), (5.0, "EX", 500, 599), (4.0, "VG-EX", 400, 499), (3.0, "VG", 300, 399),
        (2.0, "Good", 200, 299), (1.0, "Poor", 100, 199),
    ],
}

# The most offset (percent of the larger border) for each grade. tag splits its 10 in two, kept apart below.
CENTERING: dict[tuple[str, str], dict[float, float]] = {
    ("tag", "front"): {
        9: 60, 8.5: 62.5, 8: 65, 7.5: 67.5, 7: 70, 6.5: 72.5, 6: 75, 5.5: 77.5, 5: 80, 4.5: 82.5, 4: 85, 3.5: 87.5, 3: 90, 2.5: 92.5, 2: 95, 1.5: 98.33,
    },
    ("tag", "back"): {9: 75, 8: 85},
    ("psa", "front"): {10: 60, 9: 65, 8: 70, 7: 75, 6: 80, 5: 85, 4: 90},
    ("psa", "back"): {10: 75, 9: 80, 8: 90},
    ("bgs", "front"): {10: 50, 9.5: 55, 9: 60, 8.5: 65, 8: 70, 7.5: 75, 7: 80, 6: 85, 5: 90},
    ("bgs", "back"): {10: 55, 9.5: 60, 9: 70, 8: 80},
    ("cgc", "front"): {10: 55, 9.5: 60, 9: 65, 8.5: 70, 8: 75, 7: 80, 6: 85, 5: 90},
    ("cgc", "back"): {10: 60, 9.5: 65, 9: 75, 8: 85},
    ("sgc", "front"): {10: 60, 9: 65, 8: 70, 7: 75, 6: 80, 5: 90},
    ("sgc", "back"): {10: 75, 9: 80, 8: 90},
}
# tag's pristine and gem limits.
TAG_TEN = {"front": (51, 55), "back": (52, 65)}
# Centering subgrade score for each consulted grade, and below all of them.
CENTERING_SCORES = {
    "front": ({10: 970, 9.5: 945, 9: 920, 8.5: 875, 8: 825, 7.5: 775, 7: 725, 6.5: 675, 6: 625, 5.5: 575, 5: 525, 4: 425}, 350),
    "back": ({10: 970, 9.5: 945, 9: 920, 8: 825}, 700),
}
PRISTINE_SCORE = 995

# The scorer's own tables, (most offset, score), and its score below them.
TAG_CENTERING: dict[tuple[str, str], list[tuple[float, int]]] = {
    ("tcg", "front"): [(52, 995), (55, 970), (60, 920), (62.5, 860), (65, 825), (67.5, 775), (70, 725), (72.5, 675), (75, 625), (80, 525)],
    ("tcg", "back"): [(52, 995), (65, 970), (75, 920), (85, 825)],
    ("sports", "front"): [(51, 995), (55, 970), (57, 920), (62.5, 860), (65, 825), (67.5, 775), (70, 725), (75, 625), (80, 525), (90, 350)],
    ("sports", "back"): [(54.5, 995), (70, 970), (75, 920), (95, 700)],
}
TAG_CENTERING_ELSE = 400
TAG_NO_BACK = 990
# Deductions for severity 1 to 5, and for anything else.
DEDUCTIONS = {
    "CORNER_WHITENING": (30, 60, 100, 150, 200), "CORNER_SOFT": (20, 50, 80, 120, 180), "CORNER_FRAYING": (40, 80, 130, 180, 250),
    "EDGE_DAMAGE": (25, 50, 90, 140, 200), "EDGE_WHITENING": (30, 60, 100, 150, 200), "EDGE_CHIPPING": (35, 70, 120, 170, 230),
    "SURFACE_SCRATCH": (40, 80, 140, 200, 300), "SURFACE_STAIN": (50, 100, 160, 220, 320), "PRINT_LINE": (20, 40, 70, 100, 150),
    "SURFACE_CREASE": (150, 250, 350, 450, 550),
}
DEDUCTION_ELSE = 30
WHOLE_POINT_COMPANIES = ("psa", "sgc")


def chain(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The first case that holds; without one, `otherwise`."""
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(otherwise) if cases else F.lit(otherwise)


def of_company(company: Column | str, make, companies=COMPANIES) -> Column:
    """make(c) for the row's company; null for an unknown one. A plain string picks one company."""
    if isinstance(company, str):
        return make(company) if company in companies else F.lit(None)
    return chain([(company == c, make(c)) for c in companies])


def grade_from_score(score: Column, company: Column | str = "tag") -> Column:
    """struct(grade, label): the first band that holds the score; scores in gaps or outside get the lowest band."""
    band = lambda b: F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("grade", "label", "min", "max"), strict=True)))
    table = F.create_map(*(x for c in COMPANIES for x in (F.lit(c), F.array(*map(band, BANDS[c])))))  # folded to a constant
    bands = F.try_element_at(table, F.lit(company) if isinstance(company, str) else company)
    fits = F.filter(bands, lambda b: F.coalesce(score.between(b["min"], b["max"]), F.lit(False)))
    found = F.coalesce(F.get(fits, F.lit(0)), F.element_at(bands, -1))
    return F.transform(F.array(found), lambda b: F.when(b.isNotNull(), F.struct(b["grade"].alias("grade"), b["label"].alias("label"))))[0]


def with_grade(df: DataFrame, score: str = "raw_score", company: str = "company") -> DataFrame:
    """df with grade and label, as grade_from_score but by a join with the broadcast bands (a constant table): the
    fastest way for many rows."""
    bands = F.broadcast(bands_table(df.sparkSession).select(F.col("company").alias("_c"), "grade", "label", "min", "max"))
    joined = df.join(bands, (F.col("_c") == F.col(company)) & F.col(score).between(F.col("min"), F.col("max")), "left")
    low = F.create_map(*(x for c in COMPANIES for x in (F.lit(c), F.struct(F.lit(BANDS[c][-1][0]).alias("grade"), F.lit(BANDS[c][-1][1]).alias("label")))))
    last = F.try_element_at(low, F.col(company))
    return joined.withColumns({"grade": F.coalesce("grade", last["grade"]), "label": F.coalesce("label", last["label"])}).drop("_c", "min", "max")


def centering_grade(offset: Column, side: str, company: Column | str = "tag") -> Column:
    """The highest grade whose limit holds, tag's split 10 left out; else 1; null for an unknown company or side."""
    if side not in ("front", "back"):
        return F.lit(None).cast("double")
    return of_company(
        company, lambda c: chain([(offset <= v, F.lit(float(g))) for g, v in sorted(CENTERING[c, side].items(), reverse=True)], F.lit(1.0))
    )


def client_centering_score(offset: Column, side: str, company: Column | str = "tag") -> Column:
    """Centering subgrade from the company's limits; only the grades of CENTERING_SCORES are consulted."""
    scores, least = CENTERING_SCORES[side]

    def make(c: str) -> Column:
        limits = CENTERING[c, side]
        first = [(offset <= TAG_TEN[side][0], F.lit(PRISTINE_SCORE)), (offset <= TAG_TEN[side][1], F.lit(scores[10]))] if c == "tag" else []
        return chain(first + [(offset <= limits[g], F.lit(s)) for g, s in scores.items() if g in limits], F.lit(least))

    return of_company(company, make)


def tag_centering_score(offset: Column, side: str, card_type: Column | str = "tcg") -> Column:
    """The scorer's centering subgrade; every card type but sports uses the tcg table."""

    def make(kind: str) -> Column:
        return chain([(offset <= v, F.lit(s)) for v, s in TAG_CENTERING[kind, side]], F.lit(TAG_CENTERING_ELSE))

    if isinstance(card_type, str):
        return make("sports" if card_type == "sports" else "tcg")
    return F.when(card_type == "sports", make("sports")).otherwise(make("tcg"))


def tag_grade(score: Column) -> Column:
    """struct(grade, label) by least score; below all (1, Poor)."""
    return F.struct(*(chain([(score >= b[2], F.lit(b[k])) for b in BANDS["tag"]], F.lit(BANDS["tag"][-1][k])).alias(n) for k, n in ((0, "grade"), (1, "label"))))


def deduction(kind: Column, severity: Column) -> Column:
    """Points for a defect's type and severity."""
    return chain([((kind == k) & (severity == s), F.lit(d)) for k, row in DEDUCTIONS.items() for s, d in enumerate(row, start=1)], F.lit(DEDUCTION_ELSE))


def convert_grade(grade: Column, to: Column | str) -> Column:
    """Half points go up to the next whole one at companies without them."""
    whole = F.lit(to in WHOLE_POINT_COMPANIES) if isinstance(to, str) else to.isin(*WHOLE_POINT_COMPANIES)
    half = (grade * 2 == F.floor(grade * 2)) & (grade != F.floor(grade)) & grade.between(1.5, 9.5)
    return F.when(whole & half, F.ceil(grade).cast("double")).otherwise(grade)


def company_grade(score: Column, company: Column, front: Column, back: Column) -> Column:
    """struct(grade, label, ok): a tag score as another company's grade under its centering rules.

    ok: psa's centering holds, cgc and sgc are pristine; null elsewhere. A missing front counts as 50, a missing or zero back too.
    """
    known = F.struct(*(c.alias(n) for n, c in _known(score, company, front, back).items()))
    # each part is worked out once
    return F.transform(F.array(known), lambda k: F.struct(*(c.alias(n) for n, c in _company_grade(*(k[n] for n in "gfbsc")).items())))[0]


def with_company_grade(df: DataFrame, score: Column, company: Column, front: Column, back: Column) -> DataFrame:
    """df with grade, label and ok as company_grade gives them, in two projections of generated code: the fastest way for many rows."""
    parts = {f"_{n}": c for n, c in _known(score, company, front, back).items()}
    named = df.withColumns(parts).withColumns(_company_grade(*(F.col(n) for n in parts)))
    return named.drop(*parts)


def _known(score: Column, company: Column, front: Column, back: Column) -> dict[str, Column]:
    return {"g": tag_grade(score)["grade"], "f": F.coalesce(front, F.lit(50.0)), "b": F.coalesce(F.nullif(back, F.lit(0.0)), F.lit(50.0)), "s": score, "c": company}


def _company_grade(g: Column, f: Column, b: Column, score: Column, company: Column) -> dict[str, Column]:
    psa_ok = (f <= 55) & (b <= 75)
    psa = F.when(~psa_ok & (g == 10), 9.0).otherwise(g)
    sub = chain([((f <= 50) & (b <= 50), F.lit(10.0)), ((f <= 55) & (b <= 60), F.lit(9.5)), ((f <= 60) & (b <= 65), F.lit(9.0)), ((f <= 65) & (b <= 75), F.lit(8.0))], F.lit(7.0))
    bgs = F.least(g, sub + 0.5)
    pristine = (f <= 50) & (b <= 50) & (score >= 990)
    gem = (f <= 55) & (b <= 70) & (score >= 950)
    sgc = F.when((g == 10) & ~pristine & ~gem, 9.5).otherwise(g)
    grade = chain([(company == "psa", psa), (company == "bgs", bgs), (company == "sgc", sgc)], g)
    text = chain(
        [
            (company == "psa", F.concat(F.lit("PSA "), F.when(psa == F.floor(psa), psa.cast("long").cast("string")).otherwise(psa.cast("string")))),
            (company == "bgs", F.concat(F.lit("BGS "), bgs.cast("string"))),
            (company == "cgc", F.concat(F.lit("CGC "), g.cast("string"), F.when(g == 10, F.when(pristine, " Pristine").otherwise(" Gem Mint")).otherwise(""))),
            (company == "sgc", F.concat(F.lit("SGC "), sgc.cast("string"), F.when(sgc == 10, F.when(pristine, " Pristine").otherwise(" Gem Mint")).otherwise(""))),
        ],
        F.concat(F.lit("TAG "), score.cast("string")),
    )
    ok = chain([(company == "psa", psa_ok), (company.isin("cgc", "sgc"), pristine)])
    return {"grade": grade, "label": text, "ok": ok}


def bands_table(spark: SparkSession) -> DataFrame:
    """company, ord, grade, label, min, max: the bands as a small table, for joins."""
    rows = [(c, k, *b) for c in COMPANIES for k, b in enumerate(BANDS[c])]
    return spark.createDataFrame(rows, "company string, ord int, grade double, label string, min int, max int")


def centering_table(spark: SparkSession) -> DataFrame:
    """company, side, grade, most: the centering limits as a small table."""
    rows = [(c, s, float(g), float(v)) for (c, s), limits in CENTERING.items() for g, v in limits.items()]
    return spark.createDataFrame(rows, "company string, side string, grade double, most double")


def deductions_table(spark: SparkSession) -> DataFrame:
    """type, severity, points."""
    rows = [(k, s, d) for k, row in DEDUCTIONS.items() for s, d in enumerate(row, start=1)]
    return spark.createDataFrame(rows, "type string, severity int, points int")
