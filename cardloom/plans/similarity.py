"""Queries over vectors and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import distance_label
from ..operators import pivots
from ..operators import similarity as s
from .base import Inputs, query


def split(f: Inputs):
    v = f.vectors
    return v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.where("vec_id % 10 <> 0").select(F.concat(F.lit("c-"), F.col("vec_id").cast("string")).alias("card_id"), "embedding", "label")


COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[]))"
TOP = f"""top AS (SELECT * FROM (SELECT q.vec_id AS query_id, 'c-' || g.vec_id AS card_id, {COS} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, 'c-' || g.vec_id) AS rank
  FROM {{vectors}} q JOIN {{vectors}} g ON q.vec_id % 10 = 0 AND g.vec_id % 10 <> 0) WHERE rank <= 10)"""
CONF = "CASE WHEN sim >= 0.85 THEN 'high' WHEN sim >= 0.75 THEN 'medium' WHEN sim >= 0.65 THEN 'low' ELSE 'none' END"


@query("j9_w1_f20_f21_cosine_topk", f"WITH {TOP} SELECT query_id, card_id, floor(sim * 1000000 + 0.5::DOUBLE) / 1000000 AS similarity, rank, {CONF} AS confidence FROM top")
def _(f):
    q, g = split(f)
    return s.cosine_topk(q, g).withColumn("similarity", F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000)


ENRICHED = f"""WITH {TOP} SELECT query_id, t.card_id, rank, CASE WHEN CAST(substr(t.card_id, 3) AS INT) % 3 = 0 THEN 'name ' || substr(t.card_id, 3) ELSE substr(t.card_id, 3) END AS name,
    CASE WHEN CAST(substr(t.card_id, 3) AS INT) % 3 = 0 THEN 'sv1' ELSE 'c' END AS set_id, substr(t.card_id, 3) AS number,
    'https://assets.tcgdex.net/en/' || CASE WHEN CAST(substr(t.card_id, 3) AS INT) % 3 = 0 THEN 'sv/sv1' ELSE 'unknown/c' END || '/' || substr(t.card_id, 3) AS image FROM top t"""


@query("j1_f4_enriched_matches", ENRICHED)
def _(f):
    return enriched(*split(f))


def enriched(q, g):
    number = F.substring("card_id", 3, 20)
    cards = g.where("cast(substring(card_id, 3) as int) % 3 = 0").select("card_id", F.concat(F.lit("name "), number).alias("name"), F.lit("sv1").alias("set_id"), number.alias("local_id"))
    return s.cosine_topk(q, g, cards=cards).select("query_id", "card_id", "rank", "name", "set_id", "number", "image")


@query("f25_match_status", f"WITH {TOP} SELECT query_id, CASE WHEN sim >= 0.85 THEN 'matched' WHEN sim >= 0.75 THEN 'ambiguous' ELSE 'unknown' END AS status FROM top WHERE rank = 1")
def _(f):
    q, g = split(f)
    return s.match_status(q, s.cosine_topk(q, g, k=1))


@query("f20_cosine_sql", f"SELECT q.vec_id AS query_id, max(floor({COS} * 1000000 + 0.5::DOUBLE) / 1000000) AS best FROM {{vectors}} q JOIN {{vectors}} g ON q.vec_id % 50 = 0 AND g.vec_id % 10 <> 0 GROUP BY q.vec_id")
def _(f):
    q, g = split(f)
    return s.cosine_topk(q.where("query_id % 50 = 0"), g, k=1).select("query_id", (F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000).alias("best"))


@query(
    "f20_f21_cosine_topk_all_rows",
    f"""WITH top AS (SELECT * FROM (SELECT q.vec_id AS query_id, 'c-' || g.vec_id AS card_id, {COS} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, 'c-' || g.vec_id) AS rank
      FROM {{vectors}} q JOIN {{vectors}} g ON q.vec_id % 20 = 0) WHERE rank <= 10) SELECT query_id, card_id, floor(sim * 1000000 + 0.5::DOUBLE) / 1000000 AS similarity, rank, {CONF} AS confidence FROM top""",
)
def _(f):
    q, g = f.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), f.vectors.select(F.concat(F.lit("c-"), F.col("vec_id").cast("string")).alias("card_id"), "embedding")
    return s.cosine_topk(q, g).withColumn("similarity", F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000)


@query(
    "j9_w1_cosine_topk_pruned",
    f"""WITH top AS (SELECT * FROM (SELECT q.vec_id AS query_id, 'c-' || g.vec_id AS card_id, {COS} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, 'c-' || g.vec_id) AS rank
      FROM {{vectors}} q JOIN {{vectors}} g ON q.vec_id % 20 = 0) WHERE rank <= 10) SELECT query_id, card_id, floor(sim * 1000000 + 0.5::DOUBLE) / 1000000 AS similarity, rank, {CONF} AS confidence FROM top""",
)
def _(f):
    q, g, *_ = every(f)
    return pivots.cosine_topk_pruned(q, g.select("card_id", "embedding")).withColumn("similarity", F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000)


def all_rows(sql: str) -> str:
    """The same SQL with every id divisible by 20 asked against all rows."""
    return sql.replace("q.vec_id % 10 = 0 AND g.vec_id % 10 <> 0", "q.vec_id % 20 = 0")


def every(f: Inputs):
    return f.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), f.vectors.select(F.concat(F.lit("c-"), F.col("vec_id").cast("string")).alias("card_id"), "embedding", "label")


BITS = "(SELECT vec_id, label, list_transform(embedding[2:64], lambda v: CAST(v > list_aggregate(CAST(embedding[2:64] AS DOUBLE[]), 'median') AS INT)) AS b FROM {vectors})"
HASHES = f"""hashes AS (SELECT vec_id, label, list_reduce(list_transform(range(1, 64), lambda i: CAST(b[i] AS UBIGINT) << (64 - i)::UBIGINT), lambda x, y: x | y) AS h FROM {BITS})"""
DIST = "bit_count(CAST(xor(q.h, g.h) AS BIT))"
HAM = "bit_count(xor(q.h, g.h))"


def hashes(f: Inputs):
    v = f.vectors.select("vec_id", "label", s.hash_of_block(F.col("embedding")).alias("hash"))
    return v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "hash"), v.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("card_id"), "hash", "label")


@query("f22_hash_of_block", f"WITH {HASHES} SELECT vec_id, lower(printf('%016x', h)) AS hash FROM hashes")
def _(f):
    return f.vectors.select("vec_id", s.hash_of_block(F.col("embedding")).alias("hash"))


@query(
    "j10_w2_f22_f23_f24_hamming_topn",
    f"""WITH {HASHES} SELECT query_id, card_id, CAST(distance AS BIGINT) AS distance, rank, CASE WHEN distance <= 8 THEN 'high' WHEN distance <= 16 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN distance <= 10 THEN 'Excellent' WHEN distance <= 15 THEN 'Good' WHEN distance <= 20 THEN 'Fair' ELSE 'Weak' END AS label
    FROM (SELECT q.vec_id AS query_id, g.vec_id AS card_id, {HAM} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {HAM}, g.vec_id) AS rank FROM hashes q JOIN hashes g ON q.vec_id % 10 = 0 AND g.vec_id % 10 <> 0) WHERE rank <= 5""",
)
def _(f):
    q, g = hashes(f)
    return s.hamming_topn(q, g, 5).withColumn("label", distance_label(F.col("distance"))).withColumn("distance", F.col("distance").cast("long"))


@query(
    "f23_hamming_topn_all_rows",
    f"""WITH {HASHES} SELECT query_id, card_id, CAST(distance AS BIGINT) AS distance, rank FROM (SELECT q.vec_id AS query_id, g.vec_id AS card_id, {HAM} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {HAM}, g.vec_id) AS rank
      FROM hashes q JOIN hashes g ON q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def _(f):
    h = f.vectors.select("vec_id", s.hash_of_block(F.col("embedding")).alias("hash"))
    q, g = h.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), h.withColumnRenamed("vec_id", "card_id")
    return s.hamming_topn(q, g, 5).select("query_id", "card_id", F.col("distance").cast("long").alias("distance"), "rank")


@query("j10_hamming_within_banded", f"WITH {HASHES} SELECT q.vec_id AS query_id, g.vec_id AS card_id, CAST({HAM} AS BIGINT) AS distance FROM hashes q JOIN hashes g ON {HAM} <= 8")
def _(f):
    h = f.vectors.select("vec_id", s.hash_of_block(F.col("embedding")).alias("hash"))
    return s.hamming_within(h.withColumnRenamed("vec_id", "query_id"), h.withColumnRenamed("vec_id", "card_id")).withColumn("distance", F.col("distance").cast("long"))


@query(
    "j10_hamming_within_twelve",
    f"WITH {HASHES} SELECT q.vec_id AS query_id, g.vec_id AS card_id, CAST({HAM} AS BIGINT) AS distance FROM hashes q JOIN hashes g ON q.vec_id % 20 = 0 AND {HAM} <= 12",
)
def _(f):
    h = f.vectors.select("vec_id", s.hash_of_block(F.col("embedding")).alias("hash"))
    near = s.hamming_within(h.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), h.withColumnRenamed("vec_id", "card_id"), 12)
    return near.withColumn("distance", F.col("distance").cast("long"))


#: Cards made of each hash: itself and five that differ in its last bits.
VARIANTS = 6


@query(
    "w2_hamming_topn_near",
    f"""WITH {HASHES}, cards AS (SELECT vec_id * {VARIANTS} + k AS card_id, xor(h, (1::UBIGINT << k::UBIGINT) - 1::UBIGINT) AS h FROM hashes, range(0, {VARIANTS}) t(k))
    SELECT query_id, card_id, CAST(distance AS BIGINT) AS distance, rank FROM (SELECT q.vec_id AS query_id, g.card_id, {HAM} AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {HAM}, g.card_id) AS rank FROM hashes q JOIN cards g ON q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def _(f):
    h = f.vectors.select("vec_id", s.hash_of_block(F.col("embedding")).alias("hash"))
    k = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("k")
    low = F.conv(F.substring("hash", 9, 8), 16, 10).cast("long").bitwiseXOR(F.pow(F.lit(2), F.col("k")).cast("long") - 1)
    cards = h.select("vec_id", "hash", k).select((F.col("vec_id") * VARIANTS + F.col("k")).alias("card_id"), F.concat(F.substring("hash", 1, 8), F.lower(F.lpad(F.hex(low), 8, "0"))).alias("hash"))
    return s.hamming_topn_near(h.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), cards, 5).select("query_id", "card_id", F.col("distance").cast("long").alias("distance"), "rank")


ART = f"""{HASHES}, m AS (SELECT q.vec_id AS query_id, g.vec_id AS card_id, 'Name ' || g.label % 3 AS name, {HAM} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {HAM}, g.vec_id) AS rank
  FROM hashes q JOIN hashes g ON q.vec_id % 10 = 0 AND g.vec_id % 10 <> 0 QUALIFY rank <= 20),
l AS (SELECT query_id, name, list({{'r': rank, 'd': distance, 'c': card_id}} ORDER BY rank) AS items FROM m GROUP BY ALL),
s AS (SELECT query_id, name, items, list_reduce(list_transform(items, lambda x: [CAST(x.d AS INT)]), lambda a, x: list_concat(a, CASE WHEN x[1] - a[-1] <= 3 THEN [a[-1]] ELSE [x[1]] END)) AS seeds FROM l),
e AS (SELECT query_id, name, unnest(items) AS i, unnest(seeds) AS seed FROM s)"""


@query(
    "a9_group_by_artwork",
    f"WITH {ART.replace('{{', '{').replace('}}', '}')} SELECT query_id, name, seed AS distance, CASE WHEN seed <= 8 THEN 'high' WHEN seed <= 16 THEN 'medium' ELSE 'low' END AS confidence, CAST(arg_min(i.c, i.r) AS VARCHAR) AS primary_card, array_to_string(list(i.c ORDER BY i.r), ',') AS variants, CAST(count(*) AS INT) AS variant_count FROM e GROUP BY query_id, name, seed",
)
def _(f):
    q, g = hashes(f)
    top = s.hamming_topn(q, g, 20).join(g.select("card_id", F.concat(F.lit("Name "), (F.col("label") % 3).cast("string")).alias("name")), "card_id").withColumn("card_id", F.col("card_id").cast("string"))
    return s.group_by_artwork(top).withColumn("variants", F.array_join("variants", ",")).drop("rank")


@query("f15_flatten_variants", f"WITH {ART.replace('{{', '{').replace('}}', '}')} SELECT query_id, CASE WHEN seed <= 8 THEN 'high' WHEN seed <= 16 THEN 'medium' ELSE 'low' END AS confidence, CAST(count(*) OVER (PARTITION BY query_id, name, seed) AS INT) AS variant_count, CAST(i.c AS VARCHAR) AS card_id FROM e")
def _(f):
    q, g = hashes(f)
    top = s.hamming_topn(q, g, 20).join(g.select("card_id", F.concat(F.lit("Name "), (F.col("label") % 3).cast("string")).alias("name")), "card_id").withColumn("card_id", F.col("card_id").cast("string"))
    return s.flatten_variants(s.group_by_artwork(top))


MATCHED = f"WITH {TOP} SELECT query_id, CASE WHEN sim >= 0.85 THEN 'matched' WHEN sim >= 0.75 THEN 'ambiguous' ELSE 'unknown' END AS status FROM top WHERE rank = 1"


@query("j1_f4_enriched_matches_all_rows", all_rows(ENRICHED))
def _(f):
    return enriched(*every(f))


@query("f25_match_status_all_rows", all_rows(MATCHED))
def _(f):
    q, g = every(f)
    return s.match_status(q, s.cosine_topk(q, g, k=1))


def artwork(f: Inputs):
    """Groups of every 20th hash's matches among all of them."""
    h = f.vectors.select("vec_id", "label", s.hash_of_block(F.col("embedding")).alias("hash"))
    q, g = h.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "hash"), h.withColumnRenamed("vec_id", "card_id")
    names = g.select("card_id", F.concat(F.lit("Name "), (F.col("label") % 3).cast("string")).alias("name"))
    return s.group_by_artwork(s.hamming_topn(q, g, 20).join(names, "card_id").withColumn("card_id", F.col("card_id").cast("string")))


GROUPED = f"WITH {ART.replace('{{', '{').replace('}}', '}')} SELECT query_id, name, seed AS distance, CASE WHEN seed <= 8 THEN 'high' WHEN seed <= 16 THEN 'medium' ELSE 'low' END AS confidence, CAST(arg_min(i.c, i.r) AS VARCHAR) AS primary_card, array_to_string(list(i.c ORDER BY i.r), ',') AS variants, CAST(count(*) AS INT) AS variant_count FROM e GROUP BY query_id, name, seed"
FLAT = f"WITH {ART.replace('{{', '{').replace('}}', '}')} SELECT query_id, CASE WHEN seed <= 8 THEN 'high' WHEN seed <= 16 THEN 'medium' ELSE 'low' END AS confidence, CAST(count(*) OVER (PARTITION BY query_id, name, seed) AS INT) AS variant_count, CAST(i.c AS VARCHAR) AS card_id FROM e"


@query("a9_group_by_artwork_all_rows", all_rows(GROUPED))
def _(f):
    return artwork(f).withColumn("variants", F.array_join("variants", ",")).drop("rank")


@query("f15_flatten_variants_all_rows", all_rows(FLAT))
def _(f):
    return s.flatten_variants(artwork(f))
