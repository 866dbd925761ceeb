"""Scans of users: pages, searches, changes, validation, values, missing images, accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import EUR_TO_USD, half_up, truthy
from ..functions.text import default_display_name

TIERS = ("free", "pro_monthly", "beta_lifetime")
COMPANIES = ("tag", "psa", "bgs", "cgc", "sgc")
#: What a missing-image record keeps of its card.
CARD_NAMES = ("card_name", "set_name", "card_number")


def page_scans(scans: DataFrame, limit: int = 50, offset: int = 0, order_by: str = "created_at", ascending: bool = False, key: str = "id") -> DataFrame:
    """One page of every user's scans; equal order values go by id, descending like the default order."""
    order = [F.asc(order_by) if ascending else F.desc(order_by), F.desc(key)]
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long")
    return scans.withColumn("position", rank).where(F.col("position").between(offset + 1, offset + limit))


def user_page(scans: DataFrame, user_id: object, limit: int = 50, offset: int = 0, order_by: str = "created_at", ascending: bool = False) -> DataFrame:
    """One page of one user's scans: the filter reaches the files, and the sort keeps offset + limit rows."""
    order = F.asc(order_by) if ascending else F.desc(order_by)
    return scans.where(F.col("user_id") == user_id).orderBy(order, F.desc("id")).offset(offset).limit(limit)


def apply_scan_changes(scans: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """scans after a set of changes: `deleted` removes a scan; other columns, where not null, replace values.

    `set_null` (array of names, optional) lists the columns of a change that become null. A scan may have several changes: they hold
    in the order of `changed_at` (optional), of equal ones the greater value; one that deletes, deletes. A change never multiplies a scan.
    """
    values = [c for c in changes.columns if c not in (key, "deleted", "set_null", "changed_at")]
    emptied = lambda c: F.coalesce(F.array_contains("set_null", c), F.lit(False)) if "set_null" in changes.columns else F.lit(False)
    at = F.col("changed_at") if "changed_at" in changes.columns else F.lit(0)
    removed = F.coalesce(F.bool_or("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    last = [
        F.max(F.when(F.col(c).isNotNull() | emptied(c), F.struct(at.alias("at"), F.when(~emptied(c), F.col(c)).alias("value")))).alias(f"_new_{c}") for c in values
    ]
    new = changes.groupBy(key).agg(removed.alias("_deleted"), *last)
    merged = scans.join(new, key, "left").where(~F.coalesce("_deleted", F.lit(False)))
    replaced = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.value")).otherwise(F.col(c)).alias(c)
    return merged.select(*(replaced(c) if c in values else F.col(c) for c in scans.columns))


def favorite_scans(scans: DataFrame) -> DataFrame:
    """Favourites with their position in their user's newest-first list."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return scans.where("is_favorite").withColumn("position", F.row_number().over(newest).cast("long"))


def search_scans(scans: DataFrame, terms: DataFrame) -> DataFrame:
    """Each user's scans whose name holds the user's term in any case; % and _ in a term are wildcards.

    terms: user_id, term. An equi join on the user, so no term meets another user's scans.
    """
    return scans.join(terms, "user_id").where(F.ilike("card_name", F.concat(F.lit("%"), F.col("term"), F.lit("%"))))


def visible_to(df: DataFrame, access: DataFrame, owner: str = "user_id") -> DataFrame:
    """Rows that each viewer may see: access has viewer and user_id."""
    return df.join(access, df[owner] == access["user_id"]).drop(access["user_id"])


def violations(tier: Column | None = None, company: Column | None = None, raw_score: Column | None = None) -> Column:
    """Names of the broken rules; null values break none."""
    checks = []
    if tier is not None:
        checks.append(F.when(~tier.isin(*TIERS), "tier"))
    if company is not None:
        checks.append(F.when(~company.isin(*COMPANIES), "company"))
    if raw_score is not None:
        checks.append(F.when(~raw_score.between(0, 1000), "raw_score"))
    return F.array_compact(F.array(*checks))


def validate_scans(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    checked = scans.withColumn("violations", violations(company=F.col("company"), raw_score=F.col("raw_score")))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def build_scan_rows(graded: DataFrame) -> DataFrame:
    """Rows to store: the model's grade and label of the chosen company before the software's; defaults for the rest."""
    return graded.withColumns(
        {
            "grade_value": F.coalesce("ai_grade", "grade_value"),
            "grade_label": F.coalesce("ai_label", "grade_label"),
            "card_name": truthy(F.col("card_name"), ""),
            "card_game": F.coalesce(truthy(F.col("card_game"), ""), F.lit("pokemon")),
            "company": F.coalesce(truthy(F.col("company"), ""), F.lit("tag")),
        }
    ).drop("ai_grade", "ai_label")


def merge_card_info(old: Column, new: Column, fields: dict[str, bool], keep: tuple[str, ...] = ()) -> Column:
    """struct of fields: new wins where its key is present (fields: name -> present in new), even when null; keep stays old."""
    return F.when(
        old.isNotNull(), F.struct(*((new[n] if present and n not in keep else old[n]).alias(n) for n, present in fields.items()))
    ).otherwise(F.struct(*((new[n] if present else F.lit(None).cast("string")).alias(n) for n, present in fields.items())))


def collection_stats(scans: DataFrame, newest: int | None = None) -> DataFrame:
    """user_id, total_cards, total_value (dollars), avg_grade. scans: user_id, eur, ai_score, raw_score.

    newest: only each user's newest so many scans (needs created_at and id).
    """
    if newest:
        scans = page_scans(scans, newest)
    score = F.coalesce(truthy(F.col("ai_score"), 0), truthy(F.col("raw_score"), 0))
    return scans.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_cards"),
        half_up(F.coalesce(F.sum((F.col("eur") * EUR_TO_USD).cast("decimal(18,6)")).cast("double"), F.lit(0.0)), 2).alias("total_value"),
        F.coalesce(half_up(F.sum(F.when(score > 0, score)) / F.count(F.when(score > 0, score)) / 100, 1), F.lit(0.0)).alias("avg_grade"),
    )


def collection_value(scans: DataFrame) -> DataFrame:
    """user_id, eur, usd, cards_with_price, total_cards; both sums to cents."""
    exact = F.col("eur").cast("decimal(18,6)")  # of sums of doubles the order of rows could change a cent
    total = F.coalesce(F.sum(exact).cast("double"), F.lit(0.0))
    return scans.groupBy("user_id").agg(
        half_up(total, 2).alias("eur"), half_up(total * EUR_TO_USD, 2).alias("usd"), F.count("eur").alias("cards_with_price"), F.count(F.lit(1)).alias("total_cards")
    )


#: What collection totals are made of: all of it adds and subtracts exactly.
TOTALS = ("cards", "priced", "eur", "usd", "scored", "score")


def collection_totals(scans: DataFrame, sign: int = 1) -> DataFrame:
    """user_id and exact sums behind collection_stats and collection_value. scans: user_id, eur, ai_score, raw_score."""
    score = F.coalesce(truthy(F.col("ai_score"), 0), truthy(F.col("raw_score"), 0))
    scored = F.when(score > 0, score)
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(18,6)")), F.lit(0)).cast("decimal(28,6)")
    sums = (F.count(F.lit(1)), F.count("eur"), exact(F.col("eur")), exact(F.col("eur") * EUR_TO_USD), F.count(scored), F.coalesce(F.sum(scored), F.lit(0)).cast("long"))
    return scans.groupBy("user_id").agg(*((sign * x).cast("decimal(28,6)" if n in ("eur", "usd") else "long").alias(n) for n, x in zip(TOTALS, sums, strict=True)))


def merge_totals(*parts: DataFrame) -> DataFrame:
    """One row for each user from totals and signed deltas of totals; users without cards drop out."""
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("user_id").agg(*(F.sum(n).cast(every.schema[n].dataType).alias(n) for n in TOTALS))
    return merged.where("cards > 0")


def totals_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a set of changes does to the totals: the new versions of its scans (inserted or updated) less the old ones (updated or deleted)."""
    every = collection_totals(after).unionByName(collection_totals(before, -1))
    return every.groupBy("user_id").agg(*(F.sum(n).cast(every.schema[n].dataType).alias(n) for n in TOTALS))


def stats_of_totals(totals: DataFrame) -> DataFrame:
    """The columns of collection_stats, collection_value and the scan count."""
    return totals.select(
        "user_id", F.col("cards").alias("total_cards"), half_up(F.col("usd").cast("double"), 2).alias("total_value"),
        F.when(F.col("scored") > 0, half_up(F.col("score").cast("double") / F.col("scored") / 100, 1)).otherwise(0.0).alias("avg_grade"),
        half_up(F.col("eur").cast("double"), 2).alias("eur"), half_up(F.col("eur").cast("double") * EUR_TO_USD, 2).alias("usd"), F.col("priced").alias("cards_with_price"),
    )


def missing_image_rollup(reports: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """tcgdex_id, card_name (and set_name, card_number where reports have them; of the first report), report_count,
    first_reported, last_reported, resolved.

    reports: tcgdex_id, card_name, ts. old: an earlier result; counts add, first names stay. Popular cards are
    combined before the shuffle. Of reports at one time the least names count.
    """
    names = [c for c in CARD_NAMES if c in reports.columns]
    first = F.min(F.struct("ts", *names))
    new = reports.where("tcgdex_id is not null").groupBy("tcgdex_id").agg(
        *(first[c].alias(c) for c in names), F.count(F.lit(1)).alias("report_count"), F.min("ts").alias("first_reported"), F.max("ts").alias("last_reported"), F.lit(False).alias("resolved")
    )
    return new if old is None else merge_missing_images(old.select(*new.columns).unionByName(new))


def merge_missing_images(counted: DataFrame) -> DataFrame:
    """One row for each card from several results of missing_image_rollup: counts add, the first report's names stay."""
    names = [c for c in CARD_NAMES if c in counted.columns]
    first = F.min(F.struct("first_reported", *names))
    return counted.groupBy("tcgdex_id").agg(
        *(first[c].alias(c) for c in names), F.sum("report_count").alias("report_count"), F.min("first_reported").alias("first_reported"),
        F.max("last_reported").alias("last_reported"), F.max("resolved").alias("resolved"),
    )


def open_missing(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("resolved", F.lit(False)))


def delete_accounts(tables: dict[str, tuple[DataFrame, str]], users: DataFrame) -> dict[str, DataFrame]:
    """Every table (frame, owner column) without the rows of users (user_id)."""
    return {name: df.join(users.select(F.col("user_id").alias(owner)).distinct(), owner, "left_anti") for name, (df, owner) in tables.items()}


def create_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles and a default one for each user (id, email, display_name) without."""
    new = users.join(profiles.select("id"), "id", "left_anti").select(
        "id", default_display_name(F.col("display_name"), F.col("email")).alias("display_name"), F.lit("free").alias("tier"), F.lit("tag").alias("preferred_company")
    )
    return profiles.select("id", "display_name", "tier", "preferred_company").unionByName(new)
