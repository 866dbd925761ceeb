"""Catalogs and embeddings as files: JSON dumps in, chunked JSON, parquet and images out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import truthy
from ..functions.text import record_image_url, year_of_set
from .json_ranges import read_records
from .shared import stored

LISTED = "id string, localId string, name string, image string, set struct<id:string,name:string>"
HASHED = "id string, hash string, name string, set string, number string"
CHUNK = "chunkIndex int, totalChunks int, chunkCount int"
#: Rows of a range that is numbered by one task, on average.
PER_RANGE = 500_000
#: Rank of an image file's extension: the first that exists is used.
EXTENSIONS = {"png": 0, "jpg": 1, "webp": 2}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """card_id, local_id, name, image, set_id, set_name of a landed list of cards, one JSON array a file, read in ranges."""
    cards, _ = read_records(spark, path)
    return cards.select(F.from_json("text", LISTED).alias("c")).select(
        F.col("c.id").alias("card_id"), F.col("c.localId").alias("local_id"), "c.name", "c.image", F.col("c.set.id").alias("set_id"), F.col("c.set.name").alias("set_name")
    )


def read_hash_db(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hashed card of a hash catalog, one JSON object a file, read in ranges."""
    cards, _ = read_records(spark, path, field="cards")
    return cards.select(F.from_json("text", HASHED).alias("c")).select("c.*")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """card_id, embedding of one file or many chunks, read in ranges; for an id in several chunks the last chunk wins."""
    entries, headers = read_records(spark, path, "]", "embeddings")
    numbers = headers.select("file", F.from_json("header", CHUNK)["chunkIndex"].alias("chunk_index"))  # one row a file
    vector = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,array<float>>")
    each = entries.join(numbers, "file", "left").select(F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.explode(vector).alias("card_id", "embedding"))
    return each.groupBy("card_id").agg(F.max_by("embedding", "chunk_index").alias("embedding"))


def with_ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """df with a number from 0 in the column's order: ranges of about PER_RANGE rows are numbered locally, their starts are
    sums of the counts before them, so no task sees all rows. The ranged rows are stored, so counts and numbers see the same ranges."""
    parts = max(1, -(-df.count() // PER_RANGE))
    ranged = stored(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # one row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_part", "_n", "_start")


def embedding_chunks(df: DataFrame, n: int = 5, order: str = "card_id") -> DataFrame:
    """df with chunk_index: contiguous runs of ceil(total / n) rows in order (not ntile's even split)."""
    size = -(-df.count() // n) or 1
    return with_ordinal(df, order).withColumn("chunk_index", F.floor(F.col("ordinal") / size).cast("int"))


def write_embedding_chunks(df: DataFrame, path: str, n: int = 5) -> None:
    """card_id and embedding as parquet in one folder for each chunk."""
    embedding_chunks(df, n).select("card_id", "embedding", "chunk_index").write.partitionBy("chunk_index").parquet(path)


def resolve_card_images(cards: DataFrame, files: DataFrame) -> DataFrame:
    """cards (set_id, local_id) with the path of their image; cards without a file drop out.

    files: path of `{set}/{number}.{extension}` files, as the binaryFile source lists them.
    """
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/([^/]+)\.(png|jpg|webp)$", 0).alias("m")).where("m <> ''").select(
        "path", F.regexp_extract("m", r"^([^/]+)/", 1).alias("set_id"), F.regexp_extract("m", r"/([^/]+)\.\w+$", 1).alias("local_id"), F.regexp_extract("m", r"(\w+)$", 1).alias("ext")
    )
    rank = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))[F.col("ext")]
    best = named.groupBy("set_id", "local_id").agg(F.min_by("path", rank).alias("path"))
    return cards.join(best, ["set_id", "local_id"])


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all image files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def write_images_by_set(images: DataFrame, path: str) -> None:
    """set_id, local_id and content as parquet in one folder for each set."""
    images.select("set_id", "local_id", "content").write.partitionBy("set_id").parquet(path)


def flatten_cards(cards: DataFrame) -> DataFrame:
    """Full card records as flat rows: image urls, year, and prices with zero as missing; no price block gives null."""
    market = F.col("pricing")["cardmarket"]
    names = [f.name for f in cards.schema["pricing"].dataType["cardmarket"].dataType.fields]
    prices = F.when(market.isNotNull(), F.struct(*(truthy(market[n], 0.0).alias(n) for n in names)))
    return cards.select(
        F.col("id").alias("card_id"), "name", F.col("localId").alias("local_id"), F.col("set.id").alias("set_id"), F.col("set.name").alias("set_name"), F.col("set.total").alias("set_total"), "rarity", "hp",
        year_of_set(F.col("set.id")).alias("year"), record_image_url(F.col("image")).alias("image_high"), record_image_url(F.col("image"), "low").alias("image_low"),
        record_image_url(F.col("image"), "high", "webp").alias("image_high_webp"), prices.alias("pricing"),
    )


def append_scans(rows: DataFrame, path: str) -> None:
    """Stores scan rows by day; rows without updated_at get an empty one, so that changes (stored_tables.update_stored) find it."""
    if "updated_at" not in rows.columns:
        rows = rows.withColumn("updated_at", F.lit(None).cast("timestamp"))
    rows.withColumn("day", F.substring(F.col("created_at").cast("string"), 1, 10)).write.mode("append").partitionBy("day").parquet(path)
