"""Scores and grades of scans from centering and defects, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scales
from ..functions.scores import compound_backend, compound_client, half_up, max_offset, truthy

SIDES = ("FRONT", "BACK")


def severity_of(severity: Column) -> Column:
    """Missing and zero severities count as 1."""
    return F.coalesce(truthy(severity, 0.0), F.lit(1.0))


def side_weight(side: Column) -> Column:
    return F.when(side == "FRONT", 1.5).otherwise(1.0)


def condition_of_dings(dings: DataFrame, floor: float = 300.0) -> DataFrame:
    """scan_id, condition, total_dings, weighted of every scan with dings; one partial aggregation by scan."""
    kind, s = F.upper("type"), severity_of(F.col("severity"))
    points = (
        F.when(kind == "CENTERING", 0.0).when(kind.contains("SURFACE"), 40 + s * 15).when(kind.contains("CORNER"), 25 + s * 10).when(kind.contains("EDGE"), 20 + s * 8).otherwise(20.0)
    )
    w = side_weight(F.col("side"))
    return dings.groupBy("scan_id").agg(
        F.greatest(F.lit(floor), 990 - F.sum(points * w)).alias("condition"), F.count(F.lit(1)).alias("total_dings"), half_up(F.sum(s * w), 1).alias("weighted")
    )


def ding_breakdown(dings: DataFrame) -> DataFrame:
    """scan_id and counts by side and family of type."""
    kind = F.col("type")
    return dings.groupBy("scan_id").agg(
        F.count_if(F.col("side") == "FRONT").alias("front"), F.count_if(F.col("side") == "BACK").alias("back"), F.count_if(kind.contains("SURFACE")).alias("surface"),
        F.count_if(kind.contains("CORNER")).alias("corner"), F.count_if(kind.contains("EDGE")).alias("edge"), F.count_if(kind == "CENTERING").alias("centering"), F.count(F.lit(1)).alias("total"),
    )


def grade_scans(scans: DataFrame, dings: DataFrame, companies: tuple[str, ...] = scales.COMPANIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """scan_id, company, offsets, subgrades, raw_score, grade, label, total_dings, weighted for each company.

    scans: id, front_lr, front_tb, back_lr, back_tb (a missing ratio is even). Dings are aggregated before the
    companies are expanded, so the only shuffle is by scan. keep: columns of scans that come along, so that no join by scan
    follows the expansion.
    """
    even = lambda c: F.coalesce(F.col(c), F.lit(50.0))
    sized = scans.select(
        F.col("id").alias("scan_id"), *keep, max_offset(even("front_lr"), even("front_tb")).alias("front_offset"), max_offset(even("back_lr"), even("back_tb")).alias("back_offset")
    ).join(condition_of_dings(dings), "scan_id", "left").fillna({"condition": 990.0, "total_dings": 0, "weighted": 0.0})
    each = sized.withColumn("company", F.explode(F.array(*(F.lit(c) for c in companies))))
    company = F.col("company")
    scored = each.withColumns({"front_score": scales.client_centering_score(F.col("front_offset"), "front", company), "back_score": scales.client_centering_score(F.col("back_offset"), "back", company)})
    raw = scored.withColumn("raw_score", F.greatest(F.lit(300), compound_client(F.col("front_score"), F.col("back_score"), F.col("condition"))))
    return scales.with_grade(raw)


def scoring_defects(defects: DataFrame, least: float = 0.75) -> DataFrame:
    """Defects sure enough to be scored; a missing confidence is 0."""
    return defects.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def listed_defects(defects: DataFrame) -> DataFrame:
    """Defects worth listing: severity 2 and up; a missing severity is 1."""
    return defects.where(F.coalesce("severity", F.lit(1)) >= 2)


def defect_points(side: Column, kind: Column, severity: Column, confidence: Column) -> Column:
    """Deduction of one defect: base by type and severity, times confidence, times side, truncated after each."""
    base = (scales.deduction(kind, F.coalesce(severity, F.lit(1))) * F.coalesce(confidence, F.lit(0.75))).cast("int")
    return (base * side_weight(side)).cast("int")


def tag_scores(scans: DataFrame, defects: DataFrame, card_type: Column | str = "tcg", strict_side: bool = False) -> DataFrame:
    """scan_id, subgrades, tag_score, grade, label. scans: id, front_offset, back_offset (null: no picture of the back).

    strict_side compares sides literally with FRONT; else in either case.
    """
    side = F.col("side") if strict_side else F.upper("side")
    points = scoring_defects(defects).groupBy("scan_id").agg(F.sum(defect_points(side, F.col("type"), F.col("severity"), F.col("confidence"))).alias("points"))
    front = scales.tag_centering_score(F.coalesce("front_offset", F.lit(50.0)), "front", card_type)
    back = F.when(F.col("back_offset").isNull(), scales.TAG_NO_BACK).otherwise(scales.tag_centering_score(F.col("back_offset"), "back", card_type))
    scored = scans.select(F.col("id").alias("scan_id"), "front_offset", "back_offset", front.alias("front_score"), back.alias("back_score")).join(points, "scan_id", "left")
    condition = F.greatest(F.lit(500), 990 - F.least(F.coalesce("points", F.lit(0)), F.lit(400)))
    out = scored.withColumn("condition", condition.cast("int")).withColumn("tag_score", compound_backend(F.col("front_score"), F.col("back_score"), F.col("condition")))
    return out.withColumn("g", scales.tag_grade(F.col("tag_score"))).select(
        "scan_id", "front_offset", "back_offset", "front_score", "back_score", "condition", "tag_score", F.col("g.grade").alias("grade"), F.col("g.label").alias("label")
    )


def backend_dings(scored: DataFrame, defects: DataFrame) -> DataFrame:
    """scan_id, type, location: centering where it is the lowest subgrade below 970, and every listed defect (a bag)."""
    low = F.least("front_score", "back_score", "condition")
    sides = F.array_compact(
        F.array(*(F.when((F.col(f"{s}_score") == low) & (F.col(f"{s}_score") < 970), s.upper()) for s in ("front", "back")))
    )
    centering = scored.select("scan_id", F.lit("CENTERING").alias("type"), F.explode(sides).alias("location"))
    rest = listed_defects(defects).select(
        "scan_id", "type", F.concat(F.coalesce("side", F.lit("FRONT")), F.lit("_"), F.coalesce("location", F.lit("CENTER"))).alias("location")
    )
    return centering.unionByName(rest)


def centering_dings(sides: DataFrame) -> DataFrame:
    """Ding rows of sides (scan_id, side, lr, tb) off centre by more than 55 in front, 65 behind; severity: the excess."""
    worst = max_offset(F.col("lr"), F.col("tb"))
    limit = F.when(F.col("side") == "FRONT", 55.0).otherwise(65.0)
    return sides.withColumn("severity", worst - limit).where("severity > 0").select("scan_id", "side", F.lit("CENTERING").alias("type"), "severity")


def combine_sides(features: DataFrame) -> DataFrame:
    """One row for each scan from rows for each side (scan_id, side, lr, tb): has_front, has_back and both centerings.

    Of a side that comes more than once, the row with the least (lr, tb) counts, nulls first.
    """
    one = F.min(F.struct("lr", "tb"))
    wide = features.groupBy("scan_id").pivot("side", list(SIDES)).agg(one["lr"].alias("lr"), one["tb"].alias("tb"), F.count(F.lit(1)).alias("n"))
    return wide.select(
        "scan_id", F.col("FRONT_n").isNotNull().alias("has_front"), F.col("BACK_n").isNotNull().alias("has_back"),
        F.coalesce(F.when(F.col("FRONT_n").isNotNull(), max_offset(F.col("FRONT_lr"), F.col("FRONT_tb"))), F.lit(50.0)).alias("front_offset"),
        F.when(F.col("BACK_n").isNotNull(), max_offset(F.col("BACK_lr"), F.col("BACK_tb"))).alias("back_offset"),
    )


def backend_to_client(scored: DataFrame, defects: DataFrame) -> DataFrame:
    """The scorer's result as the client's dings: 20 points for each severity, and a centering ding below 970."""
    rows = defects.select("scan_id", F.upper("side").alias("side"), "type", F.col("severity").cast("long").alias("severity"), (F.col("severity") * 20).cast("long").alias("deduction"))
    parts = [rows]
    for side in ("front", "back"):
        s = F.col(f"{side}_score")
        parts.append(
            scored.where((s < 970) & (s != 0)).select(
                "scan_id", F.lit(side.upper()).alias("side"), F.lit("CENTERING").alias("type"), F.when(s < 900, 3).when(s < 950, 2).otherwise(1).cast("long").alias("severity"), (990 - s).cast("long").alias("deduction")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def population(graded: DataFrame) -> DataFrame:
    """How many scans each card has at each grade of each company."""
    return graded.groupBy("card_id", "company", "grade").agg(F.count(F.lit(1)).alias("scans"))


def leaderboard(graded: DataFrame, top: int | None = None) -> DataFrame:
    """Rank of every scan among its card's scans by score; ranks come from the (card, score) histogram, so a popular
    card is no hot window."""
    from pyspark.sql import Window

    histogram = graded.groupBy("card_id", "raw_score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("card_id").orderBy(F.desc("raw_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = histogram.select("card_id", "raw_score", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias("rank"))
    out = graded.join(ranks, ["card_id", "raw_score"])
    return out.where(F.col("rank") <= top) if top else out
