"""Queries that write tables in the catalogs' file formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import hash_of_block
from ..sources import catalog as c
from ..sources import stored_tables
from .base import query
from .streaming import scratch

#: Cards in one written JSON file.
PER_FILE = 250


def one_object_files(df: DataFrame, group: str, value, path: str) -> None:
    """Writes one JSON value for each group, each in a file of its own; groups hold PER_FILE rows at most."""
    df.groupBy(group).agg(F.to_json(value).alias("value")).write.partitionBy(group).text(path)


@query("s1_read_catalog", "SELECT card_id, local_id, name, image, set_id, 'Set ' || set_id AS set_name FROM {catalog}")
def _(f):
    at = scratch(f)
    listed = F.struct(
        F.col("card_id").alias("id"), F.col("local_id").alias("localId"), "name", "image", F.struct(F.col("set_id").alias("id"), F.concat(F.lit("Set "), F.col("set_id")).alias("name")).alias("set")
    )
    one_object_files(f.catalog.withColumn("file", F.floor(F.col("ord") / PER_FILE)), "file", F.collect_list(listed), at)
    return c.read_catalog(f.spark, f"{at}/*/*.txt")


@query("s2_read_hash_db", "SELECT 'card-' || vec_id AS id, 'n' || label AS name, 's' || label % 3 AS \"set\", CAST(vec_id AS VARCHAR) AS number, 16 AS digits FROM {vectors}")
def _(f):
    at = scratch(f)
    v = F.col("vec_id")
    card = F.struct(
        F.concat(F.lit("card-"), v.cast("string")).alias("id"), hash_of_block(F.col("embedding")).alias("hash"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"),
        F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("set"), v.cast("string").alias("number"),
    )
    whole = F.struct(F.lit("2024-01-01").alias("generated"), F.lit("1").alias("version"), F.count(F.lit(1)).alias("count"), F.collect_list(card).alias("cards"))
    one_object_files(f.vectors.withColumn("file", F.floor(v / PER_FILE)), "file", whole, at)
    return c.read_hash_db(f.spark, f"{at}/*/*.txt").select("id", "name", "set", "number", F.length("hash").alias("digits"))


@query("s3_u3_read_embeddings", "SELECT CAST(CASE WHEN vec_id % 10 = 9 THEN vec_id - 9 ELSE vec_id END AS VARCHAR) AS card_id, CAST(max(vec_id) AS BIGINT) AS from_vector FROM {vectors} GROUP BY 1")
def _(f):
    at = scratch(f)
    # every tenth id is written again, with another vector, in a later chunk
    rows = f.vectors.withColumn("chunk", F.when(F.col("vec_id") % 10 == 9, F.floor(F.col("vec_id") / PER_FILE) + 100_000).otherwise(F.floor(F.col("vec_id") / PER_FILE))).withColumn(
        "card_id", F.when(F.col("vec_id") % 10 == 9, F.col("vec_id") - 9).otherwise(F.col("vec_id")).cast("string")
    )
    chunk = F.struct(F.first("chunk").cast("int").alias("chunkIndex"), F.map_from_entries(F.collect_list(F.struct("card_id", F.array(F.col("vec_id").cast("float"))))).alias("embeddings"))
    one_object_files(rows.select("chunk", F.col("chunk").alias("file"), "card_id", "vec_id"), "file", chunk, at)
    return c.read_embeddings(f.spark, f"{at}/*/*.txt").select("card_id", F.get("embedding", F.lit(0)).cast("long").alias("from_vector"))


@query("s4_w6_embedding_chunks", "SELECT card_id, n AS ordinal, CAST(n // ((t + 4) // 5) AS INT) AS chunk_index FROM (SELECT CAST(vec_id AS VARCHAR) AS card_id, row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1 AS n, count(*) OVER () AS t FROM {vectors})")
def _(f):
    return c.embedding_chunks(f.vectors.select(F.col("vec_id").cast("string").alias("card_id")), 5).select("card_id", "ordinal", "chunk_index")


@query("s4_write_embedding_chunks", "SELECT CAST(n // ((t + 4) // 5) AS INT) AS chunk_index, count(*) AS cards, min(card_id) AS first_card FROM (SELECT CAST(vec_id AS VARCHAR) AS card_id, row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1 AS n, count(*) OVER () AS t FROM {vectors}) GROUP BY 1")
def _(f):
    at = scratch(f)
    c.write_embedding_chunks(f.vectors.select(F.col("vec_id").cast("string").alias("card_id"), "embedding"), at, 5)
    return f.spark.read.parquet(at).groupBy("chunk_index").agg(F.count(F.lit(1)).alias("cards"), F.min("card_id").alias("first_card"))


@query("s5_write_catalog", "SELECT count(*) AS cards, count(*) AS listed, 'v7' AS version FROM {catalog}")
def _(f):
    at = scratch(f)
    stored_tables.write_catalog(f.catalog, at, "v7")
    cards = stored_tables.read_written_catalog(f.spark, at).agg(F.count(F.lit(1)).alias("cards"))
    return cards.crossJoin(stored_tables.read_manifest(f.spark, at).select("version", F.col("count").alias("listed")))  # of one row and one


@query(
    "s5_a11_report_of_a_write",
    """SELECT count(*) AS count, count(*) FILTER (WHERE image IS NOT NULL AND ord % 7 <> 0) AS saved, count(*) FILTER (WHERE image IS NULL AND ord % 7 <> 0) AS failed, count(*) FILTER (WHERE ord % 7 = 0) AS skipped FROM {catalog}""",
)
def _(f):
    at = scratch(f)
    status = F.when(F.col("ord") % 7 == 0, "skipped").when(F.col("image").isNull(), "failed").otherwise("saved")
    stored_tables.write_catalog(f.catalog, at, status=status)
    return stored_tables.read_manifest(f.spark, at).select("count", *(F.col("report")[k].alias(k) for k in ("saved", "failed", "skipped")))


FILES = "SELECT card_id, 'pics/' || set_id || '/' || local_id || CASE WHEN ord % 3 = 0 THEN '.png' WHEN ord % 3 = 1 THEN '.jpg' ELSE '.webp' END AS path FROM {catalog} WHERE ord % 5 <> 0"


@query("s6_resolve_images", FILES)
def _(f):
    cards = f.catalog
    exts = F.when(F.col("ord") % 3 == 0, F.array(F.lit("webp"), F.lit("png"))).when(F.col("ord") % 3 == 1, F.array(F.lit("webp"), F.lit("jpg"))).otherwise(F.array(F.lit("webp"), F.lit("gif")))
    each = cards.where("ord % 5 <> 0").select("set_id", "local_id", F.explode(exts).alias("ext"))
    files = each.select(F.concat(F.lit("pics/"), "set_id", F.lit("/"), "local_id", F.lit("."), "ext").alias("path"))
    return c.resolve_card_images(cards, files).select("card_id", "path")


@query("s6_s7_images_by_set", "SELECT set_id, count(*) AS cards, CAST(sum(length(name)) AS BIGINT) AS bytes FROM {catalog} GROUP BY set_id")
def _(f):
    at = scratch(f)
    c.write_images_by_set(f.catalog.select("set_id", "local_id", F.encode("name", "utf-8").alias("content")), at)
    return f.spark.read.parquet(at).groupBy("set_id").agg(F.count(F.lit(1)).alias("cards"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("s8_append_scans", "SELECT created_at AS day, count(*) AS scans FROM {scans} GROUP BY 1")
def _(f):
    at = scratch(f)
    for k in (0, 1):
        c.append_scans(f.scans.where(F.col("id") % 2 == k).select("id", "user_id", "created_at").repartition("created_at"), at)
    return f.spark.read.parquet(at).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("scans"))
