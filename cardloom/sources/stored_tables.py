"""Stored tables that change: copy on write by partition, deletion vectors, and catalogs with a commit mark."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.collection import apply_scan_changes
from .shared import remove, stored

#: Keys or partitions that are broadcast or collected at once; beyond it the join is shuffled.
FEW = 1_000_000
#: Where a table keeps its deletion vectors; readers skip names that begin with an underscore.
DELETED = "_deleted"


def _fs(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, made = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(made)) if fs.exists(made) else []


# --- catalogs with a commit mark


def write_catalog(catalog: DataFrame, path: str, version: str = "v1", status: Column | None = None) -> dict:
    """Stores a catalog and its manifest in one job; gives the manifest: version, count, counts by status, day, folder.

    Rows are counted while they are written, into a folder of their own. The manifest comes last, by a rename: readers follow it, so
    a write that was killed left nothing that they see. status: a column to count by (`saved`, `failed`, ..); all rows are stored.
    """
    spark = catalog.sparkSession
    folder = f"cards-{uuid.uuid4().hex}"
    seen = Observation("catalog")
    label = F.coalesce(status.cast("string") if status is not None else F.lit("saved"), F.lit("unknown"))
    known = ("saved", "failed", "skipped")
    counts = [F.count_if(label == s).alias(s) for s in known] + [F.count_if(~label.isin(*known)).alias("other"), F.count(F.lit(1)).alias("count")]
    catalog.observe(seen, *counts).write.parquet(f"{path}/{folder}")
    found = seen.get
    day = spark.sql("SELECT date_format(current_date(), 'yyyy-MM-dd')").first()[0]
    manifest = {"version": version, "count": found["count"], "generated": day, "folder": folder, "report": {k: found[k] for k in (*known, "other")}}
    number = 1 + max([int(n[9:-5]) for n in _names(spark, path) if n.startswith("manifest-") and n.endswith(".json")], default=0)
    fs, staged = _fs(spark, f"{path}/_manifest-{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(staged, _fs(spark, f"{path}/manifest-{number:08d}.json")[1]):
        raise FileExistsError(f"another write to {path} has become number {number}")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest, one row."""
    finished = [n for n in _names(spark, path) if n.startswith("manifest-")]
    if not finished:
        raise FileNotFoundError(f"no finished catalog at {path}")
    return spark.read.schema("version string, count long, generated string, folder string, report map<string,long>").json(f"{path}/{finished[-1]}")


def read_written_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The cards of the newest finished write."""
    return spark.read.parquet(f"{path}/{read_manifest(spark, path).first()['folder']}")


# --- copy on write


def update_stored(spark: SparkSession, path: str, changes: DataFrame, partition: str = "day", key: str = "id", now: Column | None = None) -> int:
    """Applies a change set (see apply_scan_changes) to a stored table; rewrites only the partitions that hold changed rows, and gives their number.

    A row whose values come out different, null counting as a value, gets updated_at = now; one that a change leaves as it was does not.
    Partitions that lose all rows are removed. Only the key is read to find the partitions.
    """
    table = spark.read.option("mergeSchema", True).parquet(path)  # updated_at may be missing in files that no change has met
    ids = changes.select(key).distinct()
    touched = [r[0] for r in table.select(key, partition).join(ids, key, "left_semi").select(partition).distinct().limit(FEW + 1).collect()]
    if len(touched) > FEW:
        raise ValueError(f"changes touch more than {FEW} partitions")
    if not touched:
        return 0
    here = F.col(partition).isin([t for t in touched if t is not None])
    if None in touched:
        here = F.coalesce(here, F.lit(False)) | F.col(partition).isNull()
    own = table.where(here)
    values = [c for c in own.columns if c not in (key, partition, "updated_at")]
    before = own.withColumn("_before", F.struct(*values))
    changed = apply_scan_changes(before, changes, key)
    stamp = now if now is not None else F.current_timestamp()
    old = F.col("updated_at") if "updated_at" in own.columns else F.lit(None).cast("timestamp")
    differs = ~F.struct(*values).eqNullSafe(F.col("_before"))
    made = stored(changed.withColumn("updated_at", F.when(differs, stamp.cast("timestamp")).otherwise(old)).drop("_before"), "changed")
    made.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[0] for r in made.select(partition).distinct().collect()}
    for value in touched:
        if value not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe=" -_.~!@$&()+,;")
            remove(spark, f"{path}/{partition}={name}")
    return len(touched)


# --- deletion vectors


def _placed(table: DataFrame) -> DataFrame:
    """table with the name of each row's file and its position there."""
    return table.select("*", F.col("_metadata.file_path").alias("_dv_file"), F.col("_metadata.row_index").alias("_dv_at"))


def delete_rows(spark: SparkSession, path: str, keys: DataFrame, column: str) -> None:
    """Deletes the rows of a stored table whose column is among keys' (a frame of one column), by writing bitmaps of their positions only."""
    name = keys.columns[0]
    rows = _placed(spark.read.parquet(path)).select(column, "_dv_file", "_dv_at")
    gone = rows.join(keys.select(F.col(name).alias(column)).distinct(), column, "left_semi")
    bit = F.expr("shiftleft(1L, cast(_dv_at % 64 as int))")
    gone.groupBy("_dv_file", F.floor(F.col("_dv_at") / 64).alias("_dv_word")).agg(F.bit_or(bit).alias("_dv_bits")).write.mode("append").parquet(f"{path}/{DELETED}")


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table that no deletion vector marks."""
    table = spark.read.parquet(path)
    if DELETED not in _names(spark, path):
        return table
    marks = spark.read.parquet(f"{path}/{DELETED}").groupBy("_dv_file", "_dv_word").agg(F.bit_or("_dv_bits").alias("_dv_bits"))
    few = marks.limit(FEW + 1).count() <= FEW
    rows = _placed(table).withColumn("_dv_word", F.floor(F.col("_dv_at") / 64))
    met = rows.join(F.broadcast(marks) if few else marks, ["_dv_file", "_dv_word"], "left")
    live = F.coalesce(F.expr("shiftright(_dv_bits, cast(_dv_at % 64 as int)) & 1"), F.lit(0)) == 0
    return met.where(live).select(*table.columns)


def fold_deletions(spark: SparkSession, path: str) -> int:
    """Rewrites the files that deletion vectors mark, without the marked rows, and drops the vectors; gives the number of files.

    For a table without partitions. New files appear before old ones and the vectors go; until then readers would see rows twice, so
    this is for a time without readers, as all compaction of plain folders is.
    """
    if DELETED not in _names(spark, path):
        return 0
    marks = spark.read.parquet(f"{path}/{DELETED}")
    files = [r[0] for r in marks.select("_dv_file").distinct().collect()]
    table = spark.read.parquet(*files)
    rows = _placed(table).withColumn("_dv_word", F.floor(F.col("_dv_at") / 64))
    bits = marks.groupBy("_dv_file", "_dv_word").agg(F.bit_or("_dv_bits").alias("_dv_bits"))
    alive = F.coalesce(F.expr("shiftright(_dv_bits, cast(_dv_at % 64 as int)) & 1"), F.lit(0)) == 0
    live = stored(rows.join(bits, ["_dv_file", "_dv_word"], "left").where(alive).select(*table.columns), "live")
    live.write.mode("append").parquet(path)
    for name in [*files, f"{path}/{DELETED}"]:
        remove(spark, name)
    return len(files)
