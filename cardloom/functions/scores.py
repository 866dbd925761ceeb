"""Subgrades, compound scores, confidence, prices and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scales import chain, grade_from_score

EUR_TO_USD = 1.08
#: Score limits between grades that make a result less sure.
BOUNDARIES = (990, 950, 900, 850, 800, 700, 600, 500)


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves up (towards plus infinity)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def truthy(x: Column, empty: object = 0) -> Column:
    """null where x is null, zero or empty."""
    return F.nullif(x, F.lit(empty))


def max_offset(lr: Column, tb: Column) -> Column:
    """The larger border's share on the worse axis."""
    return F.greatest(lr, 100 - lr, tb, 100 - tb)


def border_ratios(left: Column, right: Column, top: Column, bottom: Column, rounding: str | None = None) -> Column:
    """struct(lr, tb) in percent; 50 without borders. rounding: None, 'half_up' or 'half_even' to one decimal."""

    def one(a: Column, b: Column) -> Column:
        raw = F.when(a + b > 0, a / (a + b) * 100).otherwise(50.0)
        return raw if rounding is None else half_up(raw, 1) if rounding == "half_up" else F.bround(raw, 1)

    return F.struct(one(left.cast("double"), right).alias("lr"), one(top.cast("double"), bottom).alias("tb"))


def compound_client(front: Column, back: Column, condition: Column) -> Column:
    """Three quarters of the least subgrade and a quarter of the mean, rounded, 300 to 1000."""
    mean = (front + back + condition) / F.lit(3.0)
    return F.greatest(F.lit(300), F.least(F.lit(1000), F.floor(F.least(front, back, condition) * F.lit(0.75) + mean * F.lit(0.25) + F.lit(0.5)))).cast("int")


def compound_backend(front: Column, back: Column, condition: Column) -> Column:
    """As compound_client, truncated, 100 to 1000."""
    mean = (front + back + condition) / F.lit(3.0)
    return F.greatest(F.lit(100), F.least(F.lit(1000), (F.least(front, back, condition) * F.lit(0.75) + mean * F.lit(0.25)).cast("int")))


def compound_subgrades(subgrades: Column) -> Column:
    """The compound over any number of subgrades in an array; null for an empty one."""
    total = F.aggregate(subgrades, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(subgrades) > 0, F.array_min(subgrades) * 0.75 + total / F.size(subgrades) * 0.25)


def bgs_final(subgrades: Column) -> Column:
    """struct(grade, label) from four subgrades: half a point over the lowest at most, none if two are lowest."""
    low = F.array_min(subgrades)
    lowest = F.size(F.filter(subgrades, lambda x: x == low))
    tens = F.size(F.filter(subgrades, lambda x: x == 10))
    grade = F.when(lowest >= 2, low).otherwise(F.least(low + 0.5, F.lit(10.0)))
    label = F.when(tens == 4, "Black").when((tens == 3) & (low == 9.5), "Gold")
    return F.struct(grade.alias("grade"), label.alias("label"))


def similarity_confidence(similarity: Column) -> Column:
    return chain([(similarity >= 0.85, F.lit("high")), (similarity >= 0.75, F.lit("medium")), (similarity >= 0.65, F.lit("low"))], F.lit("none"))


def hamming_confidence(distance: Column) -> Column:
    return chain([(distance <= 8, F.lit("high")), (distance <= 16, F.lit("medium"))], F.lit("low"))


def distance_label(distance: Column) -> Column:
    return chain([(distance <= 10, F.lit("Excellent")), (distance <= 15, F.lit("Good")), (distance <= 20, F.lit("Fair"))], F.lit("Weak"))


def card_price_eur(trend: Column, avg: Column, low: Column) -> Column:
    """The first of trend, average and low that is neither null nor zero."""
    return F.coalesce(truthy(trend, 0.0), truthy(avg, 0.0), truthy(low, 0.0))


def usd(eur: Column) -> Column:
    """Dollars, to cents."""
    return half_up(eur * EUR_TO_USD, 2)


def display_grade(ai_grade: Column, ai_label: Column, ai_score: Column, raw_score: Column, grade: Column, label: Column, company: Column, show_ai: bool = True) -> Column:
    """struct(value, label, is_ai): the shown grade, worked out anew from a score where there is one.

    ai_grade, ai_label and ai_score are the company's own; a row without any of them has no model grade.
    """
    has_ai = (ai_grade.isNotNull() | ai_label.isNotNull() | ai_score.isNotNull()) & F.lit(show_ai)
    by_ai, by_raw = grade_from_score(ai_score, company), grade_from_score(raw_score, company)
    ai = F.struct(
        F.coalesce(F.when(ai_score > 0, by_ai["grade"]), ai_grade).alias("value"), F.coalesce(F.when(ai_score > 0, by_ai["label"]), ai_label).alias("label"), F.lit(True).alias("is_ai")
    )
    own = F.struct(
        F.coalesce(F.when(raw_score > 0, by_raw["grade"]), grade).alias("value"), F.coalesce(F.when(raw_score > 0, by_raw["label"]), label).alias("label"), F.lit(False).alias("is_ai")
    )
    return F.when(has_ai, ai).otherwise(own)


def card_image(catalog: Column, user: Column, enhanced: Column) -> Column:
    """The first image that is neither null nor empty."""
    return F.coalesce(truthy(catalog, ""), truthy(user, ""), truthy(enhanced, ""))


def needs_user_image(catalog_image: Column, card_id: Column, card_name: Column) -> Column:
    """No catalog image, but the card is known by id or name."""
    return truthy(catalog_image, "").isNull() & F.coalesce(truthy(card_id, ""), truthy(card_name, "")).isNotNull()


def has_paid_access(tier: Column) -> Column:
    return F.coalesce(tier.isin("pro_monthly", "beta_lifetime"), F.lit(False))


def result_confidence(
    front_lr: Column, front_tb: Column, back_lr: Column, back_tb: Column, score: Column, front_holo: Column, back_holo: Column, front_anomaly: Column, front_surface_dings: Column
) -> Column:
    """struct(confidence, level, reasons) of a software grade. The level uses the value before it is cut at 0."""
    near = F.exists(F.array(*(F.lit(b) for b in BOUNDARIES)), lambda b: F.abs(score - b) < 20)
    boundary = F.element_at(F.filter(F.array(*(F.lit(b) for b in BOUNDARIES)), lambda b: F.abs(score - b) < 20), 1)
    checks = [
        ((front_lr == 50) & (front_tb == 50), 25, F.lit("front centering is exactly even: borders may not have been found")),
        ((back_lr == 50) & (back_tb == 50), 15, F.lit("back centering is exactly even")),
        (near, 15, F.concat(F.lit("score "), score.cast("string"), F.lit(" is near the limit "), F.when(near, boundary).cast("string"))),
        (front_holo, 10, F.lit("holo front")),
        (back_holo, 5, F.lit("high variance on the back")),
        ((front_anomaly > 10) & (front_surface_dings == 0), 10, F.lit("front surface is noisy without a ding")),
    ]
    value = F.lit(100)
    for test, points, _ in checks:
        value = value - F.when(test, points).otherwise(0)
    level = F.when(value >= 80, "HIGH").when(value >= 55, "MEDIUM").otherwise("LOW")
    reasons = F.array_compact(F.array(*(F.when(test, text) for test, _, text in checks)))
    return F.struct(F.greatest(F.lit(0), value).alias("confidence"), level.alias("level"), reasons.alias("reasons"))


def next_grade_tips(score: Column, total: Column, front: Column, surface: Column, centering: Column) -> Column:
    """Codes of what stands between a card and its next grade, by score band and numbers of dings."""
    rules = [
        (score >= 950, [(F.lit(True), F.lit("gem_mint_range"))]),
        (score >= 900, [(centering > 0, F.lit("centering_only")), (total <= 1, F.lit("one_ding_from_gem_mint"))]),
        (
            score >= 800,
            [(front > 0, F.concat(F.lit("front_dings:"), front.cast("string"))), (surface > 0, F.lit("surface_is_heaviest")), (F.lit(True), F.concat(F.lit("reduce_total:"), total.cast("string")))],
        ),
        (score >= 700, [(front >= 2, F.lit("several_front_dings")), (F.lit(True), F.concat(F.lit("fewer_needed:"), F.greatest(F.lit(0), total - 4).cast("string")))]),
        (score >= 600, [(F.lit(True), F.concat(F.lit("front_wear_pattern:"), total.cast("string"))), (surface > 0, F.lit("play_wear_limits"))]),
        (F.lit(True), [(F.lit(True), F.concat(F.lit("heavy_load:"), total.cast("string"))), (surface >= 2, F.lit("wear_on_both_sides"))]),
    ]
    return chain([(test, F.array_compact(F.array(*(F.when(t, text) for t, text in tips)))) for test, tips in rules])


def effective_centering(ignore: Column, manual: Column, other_manual: Column, ai: Column, use_ai: Column, detected: Column) -> Column:
    """Which centering counts for one side: none at all, measured by hand, the model's, or detected.

    manual: this side's hand-measured struct; other_manual: whether the front was measured by hand (then the back
    never uses the model's); ai: this side's struct, null unless both sides have one.
    """
    even = F.struct(F.lit(50.0).alias("lr"), F.lit(50.0).alias("tb"))
    return F.when(ignore, even).when(other_manual, F.coalesce(manual, detected)).when(use_ai & ai.isNotNull(), ai).otherwise(detected)


def capped_grade(categories: Column, caps: Column) -> Column:
    """The lowest category grade, then the lowest cap of the visible defects."""
    return F.least(F.array_min(categories), F.array_min(caps))


def estimated_grade(company_grade_: Column, tag: Column) -> Column:
    return F.coalesce(truthy(company_grade_, 0.0), truthy(tag, 0.0))


def displayed_centering(text: Column, ratio: Column) -> Column:
    """The model's text, else the rounded ratio (even if missing or zero) with its complement."""
    r = F.coalesce(truthy(ratio, 0.0), F.lit(50.0))
    return F.coalesce(truthy(text, ""), F.concat(F.floor(r + 0.5).cast("string"), F.lit("/"), F.floor(100 - r + 0.5).cast("string")))


def array_median(x: Column) -> Column:
    """The middle of the sorted values or the mean of the two middle ones; 0 for an empty array."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        mid = F.floor(n / 2).cast("int")
        return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(s, mid).cast("double")).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)

    return let(F.array_sort(x), middle)


def array_stdev(x: Column) -> Column:
    """Population standard deviation; 0 for an empty array."""

    def spread(s: Column) -> Column:
        n = F.size(s)
        mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / n
        return let(mean, lambda m: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n))

    return F.when(F.size(x) == 0, 0.0).otherwise(let(x, spread))
