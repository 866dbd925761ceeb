"""Queries over the catalog, recognised text and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search as s
from ..sources import stored_tables
from ..sources.shared import new_folder
from .base import query

RAW_NAME = """CASE p_partkey % 5 WHEN 0 THEN '  ' || upper(p_name) || '!! ex ' WHEN 1 THEN 'Mr. ' || p_name || '   VMAX' WHEN 2 THEN NULL WHEN 3 THEN p_name || ' EXTRA-EX' ELSE '' END"""
RAW_NUMBER = """CASE p_partkey % 6 WHEN 0 THEN 'GG' || CAST(p_partkey AS STRING) || ' / gg70' WHEN 1 THEN CAST(p_partkey AS STRING) || '/197' WHEN 2 THEN 'no ' || CAST(p_partkey AS STRING) WHEN 3 THEN 'x' WHEN 4 THEN NULL
  ELSE CAST(p_partkey AS STRING) || ' \\ 12' END"""
OCR = "SELECT p_partkey AS id, " + RAW_NAME + " AS raw_name, " + RAW_NUMBER.replace("\\", "\\\\") + " AS raw_number, CASE p_partkey % 4 WHEN 0 THEN 'HP ' || CAST(10 * p_size AS STRING) WHEN 1 THEN 'hp1' WHEN 2 THEN '12345' END AS raw_hp FROM {part}"


@query(
    "f1_f2_f3_clean_ocr",
    f"""WITH o AS ({OCR.replace(chr(92) * 2, chr(92))}), x AS (SELECT id, regexp_replace(lower(trim(coalesce(raw_number, ''))), '\\s+', '', 'g') AS flat, raw_hp,
      regexp_replace(upper(trim(coalesce(raw_name, ''))), '[^A-Z0-9\\s\\-''éÉ]', '', 'g') AS nm FROM o)
    SELECT id, trim(regexp_replace(regexp_replace(nm, '\\s+', ' ', 'g'), '\\bEX\\b', 'ex', 'g')) AS name,
    CASE WHEN regexp_matches(flat, '([a-z]*\\d+)[/\\\\]([a-z]*\\d+)') THEN regexp_extract(flat, '([a-z]*\\d+)[/\\\\]([a-z]*\\d+)', 1) ELSE nullif(regexp_extract(flat, '([a-z]*\\d+)', 1), '') END AS local_id,
    CASE WHEN regexp_matches(flat, '([a-z]*\\d+)[/\\\\]([a-z]*\\d+)') THEN regexp_extract(flat, '([a-z]*\\d+)[/\\\\]([a-z]*\\d+)', 2) END AS total,
    CAST(nullif(regexp_extract(raw_hp, '(\\d{{2,3}})', 1), '') AS INT) AS hp FROM x""",
)
def _(f):
    o = f.spark.sql(OCR, part=f.part)
    return o.select("id", t.clean_card_name(F.col("raw_name")).alias("name"), t.clean_set_number(F.col("raw_number")).alias("n"), t.clean_hp(F.col("raw_hp")).alias("hp")).select(
        "id", "name", "n.local_id", "n.total", "hp"
    )


IDS = """SELECT ord, card_id, CASE ord % 7 WHEN 0 THEN card_id || '-b' WHEN 1 THEN set_id WHEN 2 THEN '' ELSE card_id END AS cid,
  CASE ord % 9 WHEN 0 THEN 'G1' WHEN 1 THEN 'lc' WHEN 2 THEN 'A1a' WHEN 3 THEN 'SV' || local_id WHEN 4 THEN 'ecard1' WHEN 5 THEN NULL ELSE set_id END AS sid, image, rarity FROM {catalog}"""


def series_sql(col: str, variant: str) -> str:
    if variant == "short":
        return "CASE " + " ".join(f"WHEN starts_with({col}, '{p}') THEN '{v}'" for p, v in t.SHORT_SERIES) + " ELSE 'unknown' END"
    low = f"lower(coalesce({col}, ''))"
    return (
        "CASE " + " ".join(f"WHEN starts_with({low}, '{p}') THEN '{v}'" for p, v in t.SERIES) + " " + " ".join(f"WHEN {low} = '{p}' THEN '{v}'" for p, v in t.WHOLE_SERIES)
        + f" WHEN regexp_matches({low}, '^[ab]\\d') THEN 'tcgp' ELSE 'unknown' END"
    )


@query(
    "f4_f5_f6_f7_f8_card_ids",
    f"""WITH x AS ({IDS}), y AS (SELECT *, string_split(cid, '-') AS p FROM x)
    SELECT ord, coalesce(p[1], '') AS part_set, coalesce(p[2], '') AS part_number, coalesce(nullif(array_to_string(p[2:], '-'), ''), 'Unknown') AS part_name, {series_sql("sid", "long")} AS series_long, {series_sql("sid", "short")} AS series_short,
    CASE {" ".join(f"WHEN starts_with(sid, '{p}') THEN '{v}'" for p, v in t.YEARS)} END AS year,
    CASE WHEN len(p) >= 2 THEN '{t.IMAGE_HOST}/' || {series_sql("array_to_string(p[:-2], '-')", "short")} || '/' || array_to_string(p[:-2], '-') || '/' || p[-1] || '/high.png' END AS url, image || '/low.webp' AS record_url,
    rarity IS NOT NULL AND ({" OR ".join(f"contains(lower(rarity), '{w}')" for w in t.HOLO_WORDS)}) AS holo FROM y""",
)
def _(f):
    x = f.spark.sql(IDS, catalog=f.catalog)
    return x.select(
        "ord", t.card_id_parts(F.col("cid")).alias("p"), t.series_of_set(F.col("sid")).alias("series_long"), t.series_of_set(F.col("sid"), "short").alias("series_short"), t.year_of_set(F.col("sid")).alias("year"),
        t.card_image_url(F.col("cid")).alias("url"), t.record_image_url(F.col("image"), "low", "webp").alias("record_url"), t.is_holo(F.col("rarity")).alias("holo"),
    ).select("ord", F.col("p.set").alias("part_set"), F.col("p.number").alias("part_number"), F.col("p.name").alias("part_name"), "series_long", "series_short", "year", "url", "record_url", "holo")


CENT = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '55/45' WHEN 1 THEN ' 52.5 / 47.5x' WHEN 2 THEN '60' WHEN 3 THEN 'a/b' WHEN 4 THEN '1/2/3' WHEN 5 THEN NULL ELSE CAST(event_id % 100 AS STRING) || '/' || CAST(100 - event_id % 100 AS STRING) END AS a, CASE WHEN event_id % 2 = 0 THEN '51/49' END AS b FROM {events}"
NUM = "CAST(nullif(regexp_extract({}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"


@query(
    "f9_f10_parse_centering",
    f"""WITH x AS ({CENT}), y AS (SELECT *, CASE WHEN len(string_split(a, '/')) = 2 AND {NUM.format("string_split(a, '/')[2]")} IS NOT NULL THEN {NUM.format("string_split(a, '/')[1]")} END AS l, CASE WHEN b IS NOT NULL THEN 51.0::DOUBLE END AS t FROM x)
    SELECT event_id, l AS parsed_left, CASE WHEN l IS NOT NULL OR t IS NOT NULL THEN coalesce(l, 50) END AS lr, CASE WHEN l IS NOT NULL OR t IS NOT NULL THEN coalesce(t, 50) END AS tb FROM y""",
)
def _(f):
    none = F.lit(None).cast("string")
    side = F.struct(none.alias("leftRight"), F.col("a").alias("lr"), F.col("b").alias("topBottom"), none.alias("tb"))
    return f.spark.sql(CENT, events=f.events).select("event_id", t.parse_centering(F.col("a"))["left"].alias("parsed_left"), t.ai_centering(side).alias("c")).select("event_id", "parsed_left", "c.lr", "c.tb")


RESPONSES = """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'no object here' WHEN event_id % 11 = 0 THEN 'so: {"grades": {"tag": {"grade": ' ||
  CAST(event_id % 10 AS STRING) ELSE 'Sure! {"cardInfo": {"name": "n' || CAST(event_id AS STRING) || '"}, "centering": {"front": {"leftRight": "52/48"}}, "grades": {"tag": {"grade": ' || CAST(event_id % 10 AS STRING) || ', "score": 900}}} Bye.' END AS output FROM [events]"""


@query(
    "f12_f13_model_responses",
    f"""WITH x AS ({RESPONSES.replace("{", "{{").replace("}", "}}").replace("[events]", "events").replace("{{", "{").replace("}}", "}")})
    SELECT event_id, CASE WHEN output IS NULL THEN 'no_output' WHEN output = '' THEN 'empty' WHEN NOT contains(output, '{{') THEN 'no_json' WHEN event_id % 11 = 0 THEN CASE WHEN contains(output, '}}') THEN 'bad_json' ELSE 'no_json' END ELSE 'ok' END AS status,
    CASE WHEN output LIKE 'Sure%' THEN 'n' || event_id END AS name, CASE WHEN output LIKE 'Sure%' THEN CAST(event_id % 10 AS DOUBLE) END AS tag_grade, CASE WHEN output LIKE 'Sure%' THEN '52/48' ELSE '50/50' END AS front FROM x""".replace("{{", "{").replace("}}", "}"),
)
def _(f):
    f.events.createOrReplaceTempView("response_events")
    x = f.spark.sql(RESPONSES.replace("[events]", "response_events"))
    p = x.select("event_id", t.parse_response(F.col("output")).alias("p"))
    return p.select(
        "event_id", "p.status", F.col("p.analysis.cardInfo.name").alias("name"), F.col("p.analysis.grades")["tag"]["grade"].alias("tag_grade"), F.coalesce("p.analysis.centering.front.leftRight", F.lit("50/50")).alias("front")
    )


@query("f11_display_strings", "SELECT id, printf('%.1f', floor(front_lr * 10 + 0.5::DOUBLE) / 10) || '/' || printf('%.1f', floor((100 - front_lr) * 10 + 0.5::DOUBLE) / 10) AS pair, CAST(CAST(round_even(greatest(w, 100 - w), 0) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(round_even(least(w, 100 - w), 0) AS BIGINT) AS VARCHAR) AS big_first FROM (SELECT id, front_lr, CAST(id % 200 AS DOUBLE) / 2 AS w FROM {scans})")
def _(f):
    return f.scans.select("id", t.ratio_text(F.col("front_lr")).alias("pair"), t.ratio_text((F.col("id") % 200).cast("double") / 2, "big_first").alias("big_first"))


QUERY = "SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 3) WHEN 2 THEN p_name || ' holo' END AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 50 AS STRING) END AS local_id, CASE WHEN p_partkey % 2 = 0 THEN '70x' END AS total, CASE WHEN p_partkey % 5 = 0 THEN CAST(10 * p_size AS BIGINT) END AS hp FROM {part} WHERE p_partkey % 20 = 1"


@query(
    "j11_u1_a12_f16_w3_search_cards",
    f"""WITH q AS ({QUERY}), h AS (SELECT q.query_id, c.*, 0 AS source FROM q JOIN {{catalog}} c ON c.local_id = q.local_id UNION ALL
      SELECT query_id, ord, card_id, set_id, local_id, name, hp, set_total, rarity, image, trend, avg_price, low_price, 1 FROM (SELECT q.query_id, c.*, row_number() OVER (PARTITION BY q.query_id ORDER BY c.ord) AS n FROM q JOIN {{catalog}} c ON length(q.name) >= 3 AND contains(lower(c.name), lower(q.name))) WHERE n <= 50),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, card_id ORDER BY source, ord) AS n FROM h) WHERE n = 1),
    s AS (SELECT u.*, CASE WHEN q.name IS NULL THEN 0 WHEN lower(u.name) = lower(q.name) THEN 100 WHEN contains(lower(u.name), lower(q.name)) THEN 50 WHEN contains(lower(q.name), lower(u.name)) THEN 30 ELSE 0 END
      + CASE WHEN q.local_id = u.local_id THEN 40 ELSE 0 END + CASE WHEN q.total IS NOT NULL AND u.set_total = 70 THEN 30 ELSE 0 END + CASE WHEN q.hp = u.hp AND q.hp <> 0 THEN 20 ELSE 0 END AS match_score FROM u JOIN q USING (query_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, CAST(local_id AS BIGINT) DESC, source, ord) AS position FROM s)
    SELECT query_id, card_id, match_score, position FROM r WHERE position <= 50""",
)
def _(f):
    return s.search_cards(f.spark.sql(QUERY, part=f.part), f.catalog)


# Fields go by the quotient k, so each kind of name, total and hp occurs; with an own number a ' holo' name meets its card.
EVERY_FIELD = """SELECT p_partkey AS query_id, CASE k % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 3) WHEN 2 THEN p_name || ' holo' END AS name,
  CASE WHEN k % 3 = 0 THEN CAST(CASE WHEN k % 2 = 0 THEN p_partkey ELSE p_partkey % 50 END AS STRING) END AS local_id, CASE WHEN k % 2 = 0 THEN '70x' END AS total, CASE WHEN k % 5 = 0 THEN CAST(10 * p_size AS BIGINT) END AS hp
  FROM (SELECT *, CAST(floor(p_partkey / 20) AS BIGINT) AS k FROM {part} WHERE p_partkey % 20 = 0)"""


@query(
    "j11_search_cards_all_fields",
    f"""WITH q AS ({EVERY_FIELD}), h AS (SELECT q.query_id, c.*, 0 AS source FROM q JOIN {{catalog}} c ON c.local_id = q.local_id UNION ALL
      SELECT query_id, ord, card_id, set_id, local_id, name, hp, set_total, rarity, image, trend, avg_price, low_price, 1 FROM (SELECT q.query_id, c.*, row_number() OVER (PARTITION BY q.query_id ORDER BY c.ord) AS n FROM q JOIN {{catalog}} c ON length(q.name) >= 3 AND contains(lower(c.name), lower(q.name))) WHERE n <= 50),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, card_id ORDER BY source, ord) AS n FROM h) WHERE n = 1),
    s AS (SELECT u.*, CASE WHEN q.name IS NULL THEN 0 WHEN lower(u.name) = lower(q.name) THEN 100 WHEN contains(lower(u.name), lower(q.name)) THEN 50 WHEN contains(lower(q.name), lower(u.name)) THEN 30 ELSE 0 END
      + CASE WHEN q.local_id = u.local_id THEN 40 ELSE 0 END + CASE WHEN q.total IS NOT NULL AND u.set_total = 70 THEN 30 ELSE 0 END + CASE WHEN q.hp = u.hp AND q.hp <> 0 THEN 20 ELSE 0 END AS match_score FROM u JOIN q USING (query_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, CAST(local_id AS BIGINT) DESC, source, ord) AS position FROM s)
    SELECT query_id, card_id, match_score, position FROM r WHERE position <= 50""",
)
def _(f):
    return s.search_cards(f.spark.sql(EVERY_FIELD, part=f.part), f.catalog)


@query("j12_exact_card", "SELECT o_orderkey AS query_id, card_id, name FROM {orders} JOIN {catalog} ON card_id = 'sv' || CAST(1 + o_orderkey % 9 AS STRING) || '-' || CAST(o_orderkey % 400 AS STRING)")
def _(f):
    q = f.orders.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("sv"), (1 + F.col("o_orderkey") % 9).cast("string")).alias("set_id"), (F.col("o_orderkey") % 400).cast("string").alias("local_id"))
    return s.exact_card(q, f.catalog).select("query_id", "card_id", "name")


@query("p12_flatten_cards", "SELECT card_id, name, local_id, set_id, set_total, rarity, hp, image || '/high.png' AS image_high, nullif(trend, 0) AS trend, nullif(avg_price, 0) AS avg_price, nullif(low_price, 0) AS low_price, ord % 3 <> 0 AS has_pricing FROM (SELECT card_id, name, local_id, set_id, set_total, rarity, hp, image, ord, CASE WHEN ord % 3 <> 0 THEN trend END AS trend, CASE WHEN ord % 3 <> 0 THEN avg_price END AS avg_price, CASE WHEN ord % 3 <> 0 THEN low_price END AS low_price FROM {catalog})")
def _(f):
    from ..sources.catalog import flatten_cards

    c = F.col
    nested = f.catalog.select(
        c("card_id").alias("id"), "name", c("local_id").alias("localId"), F.struct(c("set_id").alias("id"), F.lit(None).cast("string").alias("name"), c("set_total").alias("total")).alias("set"), "rarity", "hp", "image",
        F.struct(F.when(c("ord") % 3 != 0, F.struct(c("avg_price").alias("avg"), c("low_price").alias("low"), c("trend"))).alias("cardmarket")).alias("pricing"),
    )
    return flatten_cards(nested).select("card_id", "name", "local_id", "set_id", "set_total", "rarity", "hp", "image_high", "pricing.trend", c("pricing.avg").alias("avg_price"), c("pricing.low").alias("low_price"), c("pricing").isNotNull().alias("has_pricing"))


@query("j7_j8_new_cards", "SELECT card_id, name FROM {catalog} WHERE ord % 4 <> 0")
def _(f):
    return s.new_cards(f.catalog.select("card_id", "name"), f.catalog.where("ord % 4 = 0"))


@query("u2_t4_merge_catalog", "SELECT card_id, CASE WHEN ord % 4 = 0 THEN 'old' ELSE name END AS name FROM {catalog} WHERE ord % 2 = 0")
def _(f):
    old = f.catalog.where("ord % 4 = 0").select("card_id", F.lit("old").alias("name"))
    return s.merge_catalog(old, f.catalog.where("ord % 2 = 0").select("card_id", "name"))


@query("a11_build_report", "SELECT CASE WHEN image IS NULL THEN 'skipped' WHEN ord % 13 = 0 THEN 'failed' ELSE 'hashed' END AS status, count(*) AS cards, min(CASE WHEN image IS NOT NULL AND ord % 13 = 0 THEN card_id || ': bad image' END) AS first_error FROM {catalog} GROUP BY ALL")
def _(f):
    status = F.when(F.col("image").isNull(), "skipped").when(F.col("ord") % 13 == 0, "failed").otherwise("hashed")
    return s.build_report(f.catalog.select("card_id", status.alias("status"), F.when(status == "failed", F.concat("card_id", F.lit(": bad image"))).alias("error")))


@query("a12_first_wins", "SELECT name, arg_min(card_id, ord) AS card_id FROM {catalog} GROUP BY name")
def _(f):
    return s.first_wins(f.catalog.select("name", "card_id", "ord"), ["name"], ["ord"]).select("name", "card_id")


@query("a11_s5_manifest", "SELECT 'v1' AS version, count(*) AS count FROM {catalog}")
def _(f):
    at = new_folder(f.spark, "catalog")
    stored_tables.write_catalog(f.catalog, at, "v1")
    return stored_tables.read_manifest(f.spark, at).select("version", "count")
