"""Cleaning of recognised text, card ids, series and years, image urls, model responses, match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scales import chain
from .scores import half_up, truthy

IMAGE_HOST = "https://assets.tcgdex.net/en"

# Set prefixes and their series, first match wins. The long list ignores case, the short one does not.
SERIES = (
    ("sv", "sv"), ("swsh", "swsh"), ("sm", "sm"), ("xy", "xy"), ("bw", "bw"), ("hgss", "hgss"), ("pl", "pl"), ("dp", "dp"), ("dv", "dp"),
    ("ex", "ex"), ("ecard", "ecard"), ("neo", "neo"), ("gym", "gym"), ("base", "base"), ("pop", "pop"), ("cel", "cel"), ("col", "col"),
    ("det", "det"), ("dc", "dc"), ("fut", "fut"), ("si", "si"), ("ru", "ru"), ("np", "np"), ("mcd", "mcd"), ("me", "me"),
)
WHOLE_SERIES = (("lc", "base"), ("g1", "g"), ("p", "p"))
SHORT_SERIES = (
    ("base", "base"), ("gym", "base"), ("neo", "base"), ("swsh", "swsh"), ("sv", "sv"), ("sm", "sm"), ("xy", "xy"), ("bw", "bw"), ("dp", "dp"), ("pl", "dp"), ("ex", "ex"),
)
# Set prefixes and their first year.
YEARS = (
    ("sv", 2023), ("swsh", 2020), ("sm", 2017), ("xy", 2014), ("bw", 2011), ("hgss", 2010), ("pl", 2009), ("dp", 2007), ("ex", 2003), ("neo", 2000), ("gym", 2000), ("base", 1999),
)
# Words of a rarity that mean a foil card.
HOLO_WORDS = ("holo", "rare v", "ultra", "secret", "rainbow", "gold", "radiant", "shiny", "full art", "illustration")

CENTERING_SIDE = T.StructType([T.StructField(n, T.StringType()) for n in ("leftRight", "lr", "topBottom", "tb")])
COMPANY_GRADE = T.StructType([T.StructField("grade", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
#: What a model's grading response holds.
RESPONSE = T.StructType(
    [
        T.StructField("cardInfo", T.StructType([T.StructField(n, T.StringType()) for n in ("name", "setName", "cardNumber", "rarity", "year")])),
        T.StructField("centering", T.StructType([T.StructField("front", CENTERING_SIDE), T.StructField("back", CENTERING_SIDE)])),
        T.StructField("condition", T.StructType([T.StructField(n, T.StringType()) for n in ("corners", "edges", "surface")])),
        T.StructField("grades", T.MapType(T.StringType(), COMPANY_GRADE)),
        T.StructField("summary", T.StructType([T.StructField("positives", T.ArrayType(T.StringType())), T.StructField("concerns", T.ArrayType(T.StringType())), T.StructField("recommendation", T.StringType())])),
        T.StructField("_bad", T.StringType()),
    ]
)


def clean_card_name(text: Column) -> Column:
    """Upper case without recognition noise, single spaces, the word EX in lower case; null becomes empty."""
    kept = F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"[^A-Z0-9\s\-'éÉ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", " "), r"\bEX\b", "ex"))


def clean_set_number(text: Column) -> Column:
    """struct(local_id, total) from texts such as 'gg44 / gg70' or '134'."""
    flat = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "")
    pair = r"([a-z]*\d+)[/\\]([a-z]*\d+)"
    whole = flat.rlike(pair)
    single = truthy(F.regexp_extract(flat, r"([a-z]*\d+)", 1), "")
    return F.struct(
        F.when(whole, F.regexp_extract(flat, pair, 1)).otherwise(single).alias("local_id"), F.when(whole, F.regexp_extract(flat, pair, 2)).alias("total")
    )


def clean_hp(text: Column) -> Column:
    """The first two or three digits in a row."""
    return truthy(F.regexp_extract(text, r"(\d{2,3})", 1), "").try_cast("int")


def leading_int(text: Column) -> Column:
    """The whole number that a text starts with; null without one."""
    return truthy(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), "").try_cast("long")


def leading_number(text: Column) -> Column:
    """The number that a text starts with; null without one."""
    return truthy(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), "").try_cast("double")


def card_id_parts(card_id: Column) -> Column:
    """struct(set, number, name) as a matcher falls back on them: parts 0 and 1, and the rest as a name."""
    parts = F.split(card_id, "-")
    name = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "-")
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("set"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("number"), F.coalesce(truthy(name, ""), F.lit("Unknown")).alias("name")
    )


def series_of_set(set_id: Column, variant: str = "long") -> Column:
    """Series of a set id by its prefix, else 'unknown'. variant: 'long' or 'short' (case-sensitive, fewer series)."""
    if variant == "short":
        return chain([(set_id.startswith(p), F.lit(s)) for p, s in SHORT_SERIES], F.lit("unknown"))
    low = F.lower(F.coalesce(set_id, F.lit("")))
    whole = [(low == n, F.lit(s)) for n, s in WHOLE_SERIES]
    return chain([(low.startswith(p), F.lit(s)) for p, s in SERIES] + whole + [(low.rlike(r"^[ab]\d"), F.lit("tcgp"))], F.lit("unknown"))


def year_of_set(set_id: Column) -> Column:
    return chain([(set_id.startswith(p), F.lit(str(y))) for p, y in YEARS])


def card_image_url(card_id: Column, quality: str = "high", fmt: str = "png") -> Column:
    """Url by the id's last part and the set before it; null for an id of one part."""
    parts = F.split(card_id, "-")
    local, set_id = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "-")
    url = F.concat_ws("/", F.lit(IMAGE_HOST), series_of_set(set_id, "short"), set_id, local, F.lit(f"{quality}.{fmt}"))
    return F.when(F.size(parts) >= 2, url)


def record_image_url(image: Column, quality: str = "high", fmt: str = "png") -> Column:
    return F.concat(truthy(image, ""), F.lit(f"/{quality}.{fmt}"))


def match_image_url(set_id: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit(IMAGE_HOST), series_of_set(set_id), set_id, number)


def is_holo(rarity: Column) -> Column:
    return F.coalesce(F.lower(rarity).rlike("|".join(HOLO_WORDS)), F.lit(False))


def parse_centering(text: Column) -> Column:
    """struct(left, right) of '55/45'; null unless there are exactly two numbers."""
    parts = F.split(text, "/")
    left, right = leading_number(F.get(parts, F.lit(0))), leading_number(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & left.isNotNull() & right.isNotNull(), F.struct(left.alias("left"), right.alias("right")))


def ai_centering(side: Column) -> Column:
    """struct(lr, tb) of a response's side: either key of an axis; one missing axis is 50; none gives null."""
    lr = parse_centering(F.coalesce(truthy(side["leftRight"], ""), side["lr"]))["left"]
    tb = parse_centering(F.coalesce(truthy(side["topBottom"], ""), side["tb"]))["left"]
    return F.when(lr.isNotNull() | tb.isNotNull(), F.struct(F.coalesce(lr, F.lit(50.0)).alias("lr"), F.coalesce(tb, F.lit(50.0)).alias("tb")))


def parse_response(text: Column) -> Column:
    """struct(status, analysis): the object between the first and the last brace, and what went wrong."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    analysis = F.from_json(truthy(found, ""), RESPONSE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    status = F.when(text.isNull(), "no_output").when(text == "", "empty").when(found == "", "no_json").when(analysis["_bad"].isNotNull(), "bad_json").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", analysis).alias("analysis"))


def default_display_name(display_name: Column, email: Column) -> Column:
    return F.coalesce(display_name, F.split_part(email, F.lit("@"), F.lit(1)))


def ratio_text(value: Column, style: str = "pair") -> Column:
    """'pair': value and complement to one decimal; 'big_first': whole numbers, the larger first (halves to even)."""
    other = 100 - value
    if style == "big_first":
        return F.concat(F.bround(F.greatest(value, other)).cast("long").cast("string"), F.lit("/"), F.bround(F.least(value, other)).cast("long").cast("string"))
    return F.concat(F.format_string("%.1f", half_up(value, 1)), F.lit("/"), F.format_string("%.1f", half_up(other, 1)))


def ding_location(lr: Column, tb: Column) -> Column:
    """'52.1L/47.9R 50.0T/50.0B'."""
    f = lambda x: F.format_string("%.1f", half_up(x, 1))
    return F.concat(f(lr), F.lit("L/"), f(100 - lr), F.lit("R "), f(tb), F.lit("T/"), f(100 - tb), F.lit("B"))


def format_price(price: Column, currency: str = "usd") -> Column:
    """Two decimals with a sign in front; null without a price."""
    return F.when(truthy(price, 0.0).isNotNull(), F.concat(F.lit("$" if currency == "usd" else "€"), F.format_string("%.2f", price)))


def match_score(name: Column, local_id: Column, total: Column, hp: Column, card_name: Column, card_local: Column, card_total: Column, card_hp: Column) -> Column:
    """Text match: 100, 50 or 30 for the name, 40 for the number, 30 for the set's total, 20 for hp."""
    q, c = F.lower(truthy(name, "")), F.lower(truthy(card_name, ""))
    by_name = F.when(c == q, 100).when(c.contains(q), 50).when(q.contains(c), 30).otherwise(0)
    return (
        by_name
        + F.when(truthy(local_id, "") == card_local, 40).otherwise(0)
        + F.when(leading_int(truthy(total, "")) == card_total, 30).otherwise(0)
        + F.when(truthy(hp, 0) == card_hp, 20).otherwise(0)
    )
