"""Queries over users' scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales, scores
from ..functions.text import default_display_name, format_price
from ..operators import collection as c
from ..sources import stored_tables
from ..sources.catalog import append_scans
from ..sources.shared import new_folder
from .base import Inputs, query
from .grading import BANDS, COMPANIES

PRICE = "coalesce(nullif(trend, 0), nullif(avg_price, 0), nullif(low_price, 0))"


def eur():
    return scores.card_price_eur(F.col("trend"), F.col("avg_price"), F.col("low_price"))


@query("p1_w7_page_per_user", "SELECT id, user_id, created_at, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM {scans}) WHERE position BETWEEN 3 AND 7")
def _(f):
    return c.page_scans(f.scans.select("id", "user_id", "created_at"), limit=5, offset=2)


@query("p1_o1_user_page", "SELECT id, user_id, raw_score, created_at FROM {scans} WHERE user_id = 7 ORDER BY raw_score ASC, id DESC LIMIT 5 OFFSET 1")
def _(f):
    return c.user_page(f.scans.select("id", "user_id", "raw_score", "created_at"), 7, limit=5, offset=1, order_by="raw_score", ascending=True)


@query(
    "p2_apply_changes",
    """SELECT id, user_id, CASE WHEN id % 5 = 1 THEN 'new ' || id ELSE card_name END AS card_name, CASE WHEN id % 5 = 2 THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM {scans} WHERE id % 5 <> 0""",
)
def _(f):
    i = F.col("id")
    changes = f.scans.where(i % 5 <= 2).select(
        "id", F.when(i % 5 == 0, True).alias("deleted"), F.when(i % 5 == 1, F.concat(F.lit("new "), i.cast("string"))).alias("card_name"), F.when(i % 5 == 2, ~F.col("is_favorite")).alias("is_favorite")
    )
    return c.apply_scan_changes(f.scans.select("id", "user_id", "card_name", "is_favorite"), changes)


@query(
    "p2_set_null_and_repeated_changes",
    """SELECT id, user_id, CASE WHEN id % 6 = 1 THEN NULL WHEN id % 6 = 2 THEN 'second ' || id ELSE card_name END AS card_name, CASE WHEN id % 6 = 2 THEN NULL ELSE is_favorite END AS is_favorite
    FROM {scans} WHERE id % 6 <> 3""",
)
def _(f):
    i = F.col("id")
    none = F.lit(None).cast("string")
    at = lambda n, name, emptied, gone=False: f.scans.select("id", F.lit(n).alias("changed_at"), name.alias("card_name"), F.lit(None).cast("boolean").alias("is_favorite"), F.array(*map(F.lit, emptied)).cast("array<string>").alias("set_null"), F.lit(gone).alias("deleted"))
    changes = (
        at(1, F.concat(F.lit("first "), i.cast("string")), []).where(i % 6 <= 2).where(i % 6 > 0)
        .unionByName(at(2, none, ["card_name"]).where(i % 6 == 1))
        .unionByName(at(3, F.concat(F.lit("second "), i.cast("string")), []).where(i % 6 == 2))
        .unionByName(at(2, none, ["is_favorite"]).where(i % 6 == 2))
        .unionByName(at(1, none, [], True).where(i % 6 == 3)).unionByName(at(2, none, []).where(i % 6 == 3))
    )
    return c.apply_scan_changes(f.scans.select("id", "user_id", "card_name", "is_favorite"), changes)


@query("p3_favorites", "SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM {scans} WHERE is_favorite")
def _(f):
    return c.favorite_scans(f.scans.select("id", "user_id", "created_at", "is_favorite")).drop("is_favorite")


@query("p4_search_scans", "SELECT s.id, s.user_id, s.card_name FROM {scans} s JOIN (SELECT id AS user_id, CASE id % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'w_dg' ELSE 'l%a' END AS term FROM {profiles}) t USING (user_id) WHERE s.card_name ILIKE '%' || t.term || '%'")
def _(f):
    terms = f.profiles.select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "RED").when(F.col("id") % 3 == 1, "w_dg").otherwise("l%a").alias("term"))
    return c.search_scans(f.scans.select("id", "user_id", "card_name"), terms).select("id", "user_id", "card_name")


@query("p5_missing_images", "SELECT id, card_id, nullif(tcgdex_image, '') IS NULL AND coalesce(nullif(card_id, ''), nullif(card_name, '')) IS NOT NULL AS needs_image FROM {scans}")
def _(f):
    return f.scans.select("id", "card_id", scores.needs_user_image(F.col("tcgdex_image"), F.col("card_id"), F.col("card_name")).alias("needs_image"))


@query("p6_paid_access", "SELECT id, tier IS NOT NULL AND tier IN ('pro_monthly', 'beta_lifetime') AS paid FROM {profiles}")
def _(f):
    return f.profiles.select("id", scores.has_paid_access(F.col("tier")).alias("paid"))


@query("p7_visible_rows", "SELECT a.viewer, count(*) AS n, CAST(sum(s.id) AS BIGINT) AS ids FROM {scans} s JOIN (SELECT id AS viewer, id AS user_id FROM {profiles} UNION ALL SELECT id, id + 1 FROM {profiles} WHERE id % 10 = 0) a USING (user_id) GROUP BY a.viewer")
def _(f):
    own = f.profiles.select(F.col("id").alias("viewer"), F.col("id").alias("user_id"))
    shared = f.profiles.where("id % 10 = 0").select(F.col("id").alias("viewer"), (F.col("id") + 1).alias("user_id"))
    return c.visible_to(f.scans.select("id", F.col("user_id").alias("owner")), own.unionByName(shared), "owner").groupBy("viewer").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "p8_validation",
    """SELECT id, array_to_string(list_filter([CASE WHEN co NOT IN ('tag', 'psa', 'bgs', 'cgc', 'sgc') THEN 'company' END, CASE WHEN sc NOT BETWEEN 0 AND 1000 THEN 'raw_score' END], lambda v: v IS NOT NULL), ',') AS violations
    FROM (SELECT id, CASE WHEN id % 6 = 0 THEN 'hga' WHEN id % 6 = 1 THEN NULL ELSE company END AS co, CASE WHEN id % 7 = 0 THEN raw_score + 500 WHEN id % 7 <> 1 THEN raw_score END AS sc FROM {scans})""",
)
def _(f):
    i = F.col("id")
    odd = f.scans.select(
        "id", F.when(i % 6 == 0, "hga").when(i % 6 != 1, F.col("company")).alias("company"), F.when(i % 7 == 0, F.col("raw_score") + 500).when(i % 7 != 1, F.col("raw_score")).alias("raw_score")
    )
    good, bad = c.validate_scans(odd)
    return bad.select("id", F.array_join("violations", ",").alias("violations")).unionByName(good.select("id", F.lit("").alias("violations")))


@query(
    "p11_s8_scan_rows",
    """SELECT id, coalesce(ai_grade, grade_value) AS grade_value, coalesce(ai_label, grade_label) AS grade_label, nullif(card_name, '') AS card_name, CASE WHEN id % 2 = 0 THEN 'pokemon' ELSE 'mtg' END AS card_game,
    CASE WHEN id % 9 = 0 THEN 'tag' ELSE company END AS company FROM {scans}""",
)
def _(f):
    i = F.col("id")
    raw = f.scans.select(
        "id", "ai_grade", "ai_label", "grade_value", "grade_label", "card_name", F.when(i % 4 == 0, "").when(i % 4 != 2, "mtg").alias("card_game"), F.when(i % 9 == 0, "").otherwise(F.col("company")).alias("company")
    )
    return c.build_scan_rows(raw)


@query(
    "p13_merge_card_info",
    "SELECT id, CASE WHEN id % 4 = 0 THEN card_number ELSE card_name END AS name, rarity, CASE WHEN id % 3 = 0 THEN NULL ELSE 'p' || id END AS pricing FROM {scans}",
)
def _(f):
    i = F.col("id")
    old = F.when(i % 3 != 0, F.struct(F.col("card_name").alias("name"), F.lit("old").alias("rarity"), F.concat(F.lit("p"), i.cast("string")).alias("pricing")))
    new = F.struct(F.when(i % 4 == 0, F.col("card_number")).otherwise(F.col("card_name")).alias("name"), F.col("rarity"), F.lit(None).cast("string").alias("pricing"))
    merged = c.merge_card_info(old, new, {"name": True, "rarity": True, "pricing": True}, keep=("pricing",))
    return f.scans.select("id", merged.alias("m")).select("id", "m.*")


STATS = f"""SELECT user_id, count(*) AS total_cards, floor(coalesce(CAST(sum(CAST({PRICE} * 1.08::DOUBLE AS DECIMAL(18, 6))) AS DOUBLE), 0::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS total_value,
    coalesce(floor(CAST(sum(CASE WHEN coalesce(nullif(ai_score, 0), raw_score) > 0 THEN coalesce(nullif(ai_score, 0), raw_score) END) AS DOUBLE) / count(CASE WHEN coalesce(nullif(ai_score, 0), raw_score) > 0 THEN 1 END) / 100 * 10 + 0.5::DOUBLE) / 10, 0) AS avg_grade FROM"""


@query("a5_collection_stats", f"{STATS} {{scans}} GROUP BY user_id")
def _(f):
    return c.collection_stats(f.scans.withColumn("eur", eur()))


@query("a5_newest_scans_only", f"{STATS} (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM {{scans}}) WHERE rn <= 5) GROUP BY user_id")
def _(f):
    return c.collection_stats(f.scans.withColumn("eur", eur()), newest=5)


@query(
    "a6_collection_value",
    f"""SELECT user_id, floor(t * 100 + 0.5::DOUBLE) / 100 AS eur, floor(t * 1.08::DOUBLE * 100 + 0.5::DOUBLE) / 100 AS usd, cards_with_price, total_cards
    FROM (SELECT user_id, coalesce(sum({PRICE}), 0::DOUBLE) AS t, count({PRICE}) AS cards_with_price, count(*) AS total_cards FROM {{scans}} GROUP BY user_id)""",
)
def _(f):
    return c.collection_value(f.scans.select("user_id", eur().alias("eur")))


@query("a7_scan_count", "SELECT user_id, count(*) AS scans FROM {scans} GROUP BY user_id")
def _(f):
    return f.scans.groupBy("user_id").agg(F.count(F.lit(1)).alias("scans"))


#: A table of scans after deletions, updates and insertions; every seventh scan is deleted, every fifth rescored, every eleventh scanned again.
AFTER = """(SELECT user_id, trend, avg_price, low_price, CASE WHEN id % 5 = 1 THEN NULL ELSE ai_score END AS ai_score, CASE WHEN id % 5 = 1 THEN raw_score + 10 ELSE raw_score END AS raw_score FROM {scans} WHERE id % 7 <> 0
    UNION ALL SELECT user_id + 1, trend, avg_price, low_price, ai_score, raw_score FROM {scans} WHERE id % 11 = 0)"""


@query(
    "a5_a6_a7_totals_by_deltas",
    f"""WITH after AS {AFTER}, a AS ({STATS} after GROUP BY user_id),
    b AS (SELECT user_id, coalesce(sum({PRICE}), 0::DOUBLE) AS t, count({PRICE}) AS cards_with_price FROM after GROUP BY user_id)
    SELECT a.*, floor(t * 100 + 0.5::DOUBLE) / 100 AS eur, floor(t * 1.08::DOUBLE * 100 + 0.5::DOUBLE) / 100 AS usd, cards_with_price FROM a JOIN b USING (user_id)""",
)
def _(f):
    scans = f.scans.withColumn("eur", eur()).select("id", "user_id", "eur", "ai_score", "raw_score")
    i = F.col("id")
    again = scans.where(i % 11 == 0).withColumn("user_id", F.col("user_id") + 1)
    rescored = scans.where((i % 5 == 1) & (i % 7 != 0)).withColumns({"ai_score": F.lit(None).cast("long"), "raw_score": F.col("raw_score") + 10})
    delta = c.totals_delta(scans.where((i % 7 == 0) | (i % 5 == 1)), rescored.unionByName(again))
    return c.stats_of_totals(c.merge_totals(c.collection_totals(scans), delta))


ROLLUP = """SELECT tcgdex_id, arg_min(card_name, ts) AS card_name, count(*) AS report_count, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM {reports}"""


def in_us(df):
    return df.select("tcgdex_id", "card_name", "report_count", F.unix_micros(F.col("first_reported").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_reported").cast("timestamp")).alias("last_us"))


@query("a8_missing_image_rollup", f"{ROLLUP} GROUP BY tcgdex_id")
def _(f):
    return in_us(c.missing_image_rollup(f.reports))


@query("a8_missing_image_merge", f"{ROLLUP} GROUP BY tcgdex_id")
def _(f):
    old = c.missing_image_rollup(f.reports.where("old"))
    return in_us(c.missing_image_rollup(f.reports.where("not old"), old))


RECORDS = """SELECT tcgdex_id, arg_min(card_name, ts) AS card_name, arg_min('set ' || event_id % 9, ts) AS set_name, arg_min(CAST(event_id % 200 AS VARCHAR), ts) AS card_number,
  count(*) AS report_count FROM {reports} GROUP BY tcgdex_id"""


def full_reports(reports):
    """Reports with set and number, as scans give them."""
    return reports.withColumns({"set_name": F.concat(F.lit("set "), (F.col("event_id") % 9).cast("string")), "card_number": (F.col("event_id") % 200).cast("string")})


@query("a8_missing_image_records", RECORDS)
def _(f):
    reports = full_reports(f.reports)
    return c.missing_image_rollup(reports.where("not old"), c.missing_image_rollup(reports.where("old"))).select("tcgdex_id", "card_name", "set_name", "card_number", "report_count")


@query("p14_open_missing", "SELECT tcgdex_id, count(*) AS report_count FROM {reports} GROUP BY tcgdex_id HAVING min(event_id) % 2 = 0")
def _(f):
    rolled = f.reports.groupBy("tcgdex_id").agg(F.count(F.lit(1)).alias("report_count"), (F.min("event_id") % 2 != 0).alias("resolved"))
    return c.open_missing(rolled).drop("resolved")


@query(
    "f37_display_grades",
    f"""WITH {BANDS}, {COMPANIES}, x AS (SELECT s.*, c.company AS shown, CASE WHEN s.company = c.company THEN ai_score END AS ais, CASE WHEN s.company = c.company THEN ai_grade END AS aig, CASE WHEN s.company = c.company THEN ai_label END AS ail FROM {{scans}} s CROSS JOIN companies c),
    y AS (SELECT *, ais IS NOT NULL OR aig IS NOT NULL OR ail IS NOT NULL AS is_ai FROM x)
    SELECT id, shown, is_ai, CASE WHEN is_ai THEN CASE WHEN ais > 0 THEN coalesce(a.grade, 1) ELSE aig END ELSE coalesce(r.grade, 1) END AS value, CASE WHEN is_ai THEN CASE WHEN ais > 0 THEN coalesce(a.label, 'Poor') ELSE ail END ELSE coalesce(r.label, 'Poor') END AS label
    FROM y LEFT JOIN bands a ON a.company = shown AND ais BETWEEN a.lo AND a.hi LEFT JOIN bands r ON r.company = shown AND raw_score BETWEEN r.lo AND r.hi""",
)
def _(f):
    each = f.scans.withColumn("shown", F.explode(F.array(*map(F.lit, scales.COMPANIES))))
    own = lambda x: F.when(F.col("company") == F.col("shown"), F.col(x))
    d = scores.display_grade(own("ai_grade"), own("ai_label"), own("ai_score"), F.col("raw_score"), F.col("grade_value"), F.col("grade_label"), F.col("shown"))
    return each.select("id", "shown", d.alias("d")).select("id", "shown", "d.is_ai", "d.value", "d.label")


@query("f38_card_image", "SELECT id, coalesce(nullif(tcgdex_image, ''), nullif(user_card_image, ''), nullif(enhanced_front_path, '')) AS image FROM {scans}")
def _(f):
    return f.scans.select("id", scores.card_image(F.col("tcgdex_image"), F.col("user_card_image"), F.col("enhanced_front_path")).alias("image"))


@query("f39_f11_card_price", f"SELECT id, {PRICE} AS eur, floor({PRICE} * 1.08::DOUBLE * 100 + 0.5::DOUBLE) / 100 AS usd, '$' || printf('%.2f', floor({PRICE} * 1.08::DOUBLE * 100 + 0.5::DOUBLE) / 100) AS shown FROM {{scans}}")
def _(f):
    return f.scans.select("id", eur().alias("eur"), scores.usd(eur()).alias("usd"), format_price(scores.usd(eur())).alias("shown"))


@query(
    "f51_f52_displayed_values",
    """SELECT id, CASE WHEN id % 4 = 1 THEN '52/48' ELSE CAST(CAST(floor(coalesce(nullif(back_lr, 0), 50) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor(100 - coalesce(nullif(back_lr, 0), 50) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END AS centering,
    coalesce(nullif(ai_grade, 0), nullif(CAST(ai_score AS DOUBLE), 0)) AS estimated FROM {scans}""",
)
def _(f):
    text = F.when(F.col("id") % 4 == 1, "52/48").when(F.col("id") % 4 == 2, "")
    return f.scans.select("id", scores.displayed_centering(text, F.col("back_lr")).alias("centering"), scores.estimated_grade(F.col("ai_grade"), F.col("ai_score").cast("double")).alias("estimated"))


@query(
    "j14_delete_accounts",
    """SELECT 'profiles' AS tbl, id AS owner, 1 AS n FROM {profiles} WHERE id % 10 <> 3 UNION ALL SELECT 'scans', user_id, CAST(count(*) AS INT) FROM {scans} WHERE user_id % 10 <> 3 GROUP BY user_id""",
)
def _(f):
    users = f.profiles.where("id % 10 = 3").select(F.col("id").alias("user_id"))
    left = c.delete_accounts({"profiles": (f.profiles.select("id"), "id"), "scans": (f.scans.select("id", "user_id"), "user_id")}, users)
    return left["profiles"].select(F.lit("profiles").alias("tbl"), F.col("id").alias("owner"), F.lit(1).alias("n")).unionByName(
        left["scans"].groupBy(F.col("user_id").alias("owner")).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("scans").alias("tbl"), "owner", "n")
    )


@query(
    "j15_f14_create_profiles",
    """SELECT id, coalesce(display_name, split_part(email, '@', 1)) AS display_name, CASE WHEN id % 3 = 0 THEN coalesce(tier, '-') ELSE 'free' END AS tier, CASE WHEN id % 3 = 0 THEN 'psa' ELSE 'tag' END AS preferred_company FROM {profiles}""",
)
def _(f):
    known = f.profiles.where("id % 3 = 0").select(
        "id", default_display_name(F.col("display_name"), F.col("email")).alias("display_name"), F.coalesce("tier", F.lit("-")).alias("tier"), F.lit("psa").alias("preferred_company")
    )
    return c.create_profiles(f.profiles.select("id", "email", "display_name"), known)


@query(
    "p2_update_stored_scans",
    """SELECT id, user_id, CASE WHEN id % 50 = 1 THEN 'new ' || id WHEN id % 50 = 2 THEN NULL ELSE card_name END AS card_name, CAST(created_at AS VARCHAR) AS day, id % 50 = 1 OR id % 50 = 2 AS stamped
    FROM {scans} WHERE id % 50 <> 3 OR created_at >= '1995-01-01'""",
)
def _(f):
    at, i = new_folder(f.spark, "scans"), F.col("id")
    append_scans(f.scans.select("id", "user_id", "card_name", "created_at").repartition("created_at"), at)
    named = f.scans.where((i % 50 == 1) | (i % 50 == 2) | (i % 50 == 4)).select(
        "id", F.when(i % 50 == 1, F.concat(F.lit("new "), i.cast("string"))).when(i % 50 == 4, F.col("card_name")).alias("card_name"),
        F.when(i % 50 == 2, F.array(F.lit("card_name"))).alias("set_null"), F.lit(False).alias("deleted"),
    )
    gone = f.scans.where((i % 50 == 3) & (F.col("created_at") < "1995-01-01")).select("id", F.lit(None).cast("string").alias("card_name"), F.lit(None).cast("array<string>").alias("set_null"), F.lit(True).alias("deleted"))
    stored_tables.update_stored(f.spark, at, named.unionByName(gone))
    return f.spark.read.parquet(at).select("id", "user_id", "card_name", F.col("day").cast("string").alias("day"), F.col("updated_at").isNotNull().alias("stamped"))


@query("j14_delete_by_vectors", "SELECT user_id, count(*) AS scans, CAST(sum(raw_score) AS BIGINT) AS score FROM {scans} WHERE user_id % 10 <> 3 GROUP BY user_id")
def _(f):
    at = new_folder(f.spark, "scans")
    f.scans.select("id", "user_id", "raw_score").write.parquet(at)
    for k in (3, 13):  # two deletions, one after the other
        users = f.profiles.where(F.col("id") % 20 == k).select(F.col("id").alias("user_id"))
        stored_tables.delete_rows(f.spark, at, users, "user_id")
    return stored_tables.read_live(f.spark, at).groupBy("user_id").agg(F.count(F.lit(1)).alias("scans"), F.sum("raw_score").cast("long").alias("score"))
