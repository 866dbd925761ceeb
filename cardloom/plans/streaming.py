"""Queries that drive a stream over a table to its end and return what it left.

Each run uses its own folder below spark.checkpoint.dir (a local one only where none is set).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up
from ..sources.shared import new_folder
from ..streaming import jobs
from ..streaming.in_order import started
from .base import ADAPTERS, Inputs, query
from .centering import FOLD
from .collection import RECORDS, ROLLUP, full_reports, in_us


def scratch(f: Inputs) -> str:
    return new_folder(f.spark, "stream")


def streamed(f: Inputs, name: str) -> DataFrame:
    """A table as a stream of its files."""
    df = getattr(f, name)
    return f.spark.readStream.schema(df.schema).parquet(f"{f.sf_dir}/{name}.parquet{'' if several(f, name) else '*'}")


def several(f: Inputs, name: str) -> bool:
    return len(getattr(f, name).inputFiles()) > 1


def adapted(f: Inputs, adapter: str) -> DataFrame:
    """A one-table adapter over the stream of its table."""
    return f.spark.sql(ADAPTERS[adapter], events=streamed(f, "events"))


#: Batches that the ordered streams get their rows in, and how far a row may be moved out of its place, in minutes.
BATCHES, MOVED = 5, 60
#: Rows of a batch's file, on average.
PER_FILE = 500_000


def disordered(f: Inputs, per_file: int = PER_FILE) -> DataFrame:
    """The events as a stream of BATCHES batches in rough order of time, each row moved by up to MOVED minutes, and a heartbeat at the end.

    Every batch has equally many files, and every file a heartbeat, so that none is left out for having no rows.
    """
    at = scratch(f)
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(MOVED * 60_000_000))
    # quarters of an hour of a stream that lasts for days: each batch has all rows between two times
    low, high, rows = f.events.select(moved.alias("m")).agg(F.min("m"), F.max("m"), F.count(F.lit(1))).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // BATCHES))
    files = max(1, -(-rows // (BATCHES * per_file)))

    def beats(micros: int) -> DataFrame:
        nothing = [F.lit(None).cast(c.dataType).alias(c.name) for c in f.events.schema if c.name != "ts"]
        ts = F.timestamp_micros(F.lit(micros)).cast(f.events.schema["ts"].dataType).alias("ts")
        return f.spark.range(files).select(*nothing, ts, F.col("id").cast("int").alias("_file"))

    def land(df: DataFrame) -> None:
        df.repartitionById(files, F.col("_file")).drop("_file").write.mode("append").option("maxRecordsPerFile", 0).parquet(at)

    spread = f.events.withColumn("_file", F.pmod(F.xxhash64("event_id", "ts"), F.lit(files)).cast("int"))
    for k in range(BATCHES):
        land(spread.where(F.floor((moved - (low or 0)) / step) == k).unionByName(beats(low or 0)))
    land(beats((high or 0) + 10 * MOVED * 60_000_000))
    return f.spark.readStream.schema(f.events.schema).option("maxFilesPerTrigger", files).parquet(at)


def finished(f: Inputs, df: DataFrame) -> DataFrame:
    """Runs a stream of ordered folds to its end into the shared folder; gives the rows that were not late."""
    at = scratch(f)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/b={batch_id}")

    started(df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True), f.spark).awaitTermination()
    return f.spark.read.parquet(f"{at}/out").where("not late")


@query("t1_missing_image_stream", f"{ROLLUP} GROUP BY tcgdex_id")
def _(f):
    at = scratch(f)
    jobs.missing_image_stream(adapted(f, "reports"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return in_us(jobs.missing_images(f"{at}/out", f.spark))


@query("t1_missing_image_records_stream", RECORDS)
def _(f):
    at = scratch(f)
    jobs.missing_image_stream(full_reports(adapted(f, "reports")), f"{at}/out", f"{at}/checkpoint", every=1).awaitTermination()
    return jobs.missing_images(f"{at}/out", f.spark).select("tcgdex_id", "card_name", "set_name", "card_number", "report_count")


@query("t2_calibration_stream", FOLD + " SELECT device, kind, n AS count, floor(o_left * 1000000 + 0.5::DOUBLE) / 1000000 AS o_left, floor(o_right * 1000000 + 0.5::DOUBLE) / 1000000 AS o_right FROM fold")
def _(f):
    names = ["o_left", "o_right"]
    samples = f.spark.sql(ADAPTERS["samples"].replace("event_id,", "event_id, ts,"), events=disordered(f))
    every = finished(f, jobs.calibration_stream(samples, names, f"{MOVED} minutes"))
    last = every.groupBy("device", "kind").agg(F.max(F.struct("count", *names)).alias("m")).select("device", "kind", "m.*")
    return last.withColumns({n: half_up(F.col(n), 6) for n in names})


@query(
    "t3_stability_stream",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n, x_left IS NOT NULL AND fill > 15 AND fill < 92 AS ok FROM {frames}),
    g AS (SELECT *, lag(ok) OVER w AND abs(x_left - lag(x_left) OVER w) < 3 AND abs(top - lag(top) OVER w) < 3 AND abs(width - lag(width) OVER w) < 3 AS near FROM f WINDOW w AS (PARTITION BY session_id ORDER BY n)),
    h AS (SELECT *, max(CASE WHEN NOT ok OR NOT coalesce(near, false) THEN n END) OVER (PARTITION BY session_id ORDER BY n) AS start FROM g)
    SELECT event_id, session_id, CAST(CASE WHEN NOT ok THEN 0 ELSE least(n - start + 1, 15) END AS INT) AS run FROM h""",
)
def _(f):
    frames = f.spark.sql(ADAPTERS["frames"], events=disordered(f))
    return finished(f, jobs.stability_stream(frames, f"{MOVED} minutes")).select("event_id", "session_id", "run")


@query("t4_catalog_stream", "SELECT p_partkey AS card_id, p_name AS name FROM part")
def _(f):
    at = scratch(f)
    listing = streamed(f, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("name"))
    for _ in range(2):  # the second run finds nothing new
        jobs.catalog_stream(listing, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return f.spark.read.parquet(f"{at}/out").select("card_id", "name")
