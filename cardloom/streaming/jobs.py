"""The four running states as Structured Streaming jobs.

Counters of missing images (order does not matter, so no watermark), calibration means and frame runs (order matters: rows
wait for the watermark and are folded in event order, late ones come out marked), and the incremental catalog (each landed file is taken once).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.collection import merge_missing_images, missing_image_rollup
from ..operators.sequences import LONGEST_RUN, MEMORY
from ..sources.shared import remove
from .in_order import fold_in_order, started


#: Batches after which the counters of missing images are folded into one table.
COMPACT_EVERY = 32


def numbered_folders(base: str, prefix: str, spark: SparkSession) -> list[int]:
    """Numbers n of the finished tables `{prefix}={n}` below base."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(base)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(base))]
    return sorted(int(n[len(prefix) + 1 :]) for n in names if n.startswith(f"{prefix}=") and fs.exists(path(f"{base}/{n}/_SUCCESS")))


def missing_images(base: str, spark: SparkSession, until: int | None = None) -> DataFrame | None:
    """The counters that a missing_image_stream has written so far: its last whole table and the batches after it, merged."""
    whole = [n for n in numbered_folders(base, "whole", spark) if until is None or n < until]
    after = [n for n in numbered_folders(base, "batch", spark) if n > max(whole, default=-1) and (until is None or n <= until)]
    parts = [f"{base}/whole={n}" for n in whole[-1:]] + [f"{base}/batch={n}" for n in after]
    if not parts:
        return None
    tables = [spark.read.parquet(p) for p in parts]
    return merge_missing_images(reduce(DataFrame.unionByName, tables))


def missing_image_stream(reports: DataFrame, out: str, checkpoint: str, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Counts each batch of reports (tcgdex_id, card_name, ts; optionally set_name, card_number) into a small table of its own below out.

    After every so many batches the last whole table and the batches after it become the next whole table, and what
    they replace is removed one round later. missing_images() reads the state. A batch that runs again writes the same tables again.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        missing_image_rollup(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            missing_images(out, spark, batch_id).write.mode("overwrite").parquet(f"{out}/whole={batch_id}")
            before = batch_id - every
            for prefix in ("batch", "whole"):
                for n in numbered_folders(out, prefix, spark):
                    if n < before or (prefix == "batch" and n == before):
                        remove(spark, f"{out}/{prefix}={n}")

    return reports.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_image_counts(reports: DataFrame) -> DataFrame:
    """The same counters as a streaming aggregate, for update mode sinks."""
    return reports.groupBy("tcgdex_id").agg(F.count(F.lit(1)).alias("report_count"), F.min("ts").alias("first_reported"), F.max("ts").alias("last_reported"))


def fold_mean(count: int, mean: list[float], values: list[list[float]]) -> tuple[int, list[float]]:
    """History weighs min(count, MEMORY), each new sample 1."""
    for v in values:
        w = min(count, MEMORY)
        mean = v if not count else [(m * w + x) / (w + 1) for m, x in zip(mean, v, strict=True)]
        count += 1
    return count, mean


def calibration_stream(samples: DataFrame, fractions: list[str], delay: str = "1 hour") -> DataFrame:
    """device, kind, event_id, late, count and the running mean of each fraction after each sample (ts, event_id), in event order."""

    def fold(state: tuple | None, values: tuple) -> tuple[tuple, tuple]:
        count, mean = fold_mean(state[0] if state else 0, list(state[1:]) if state else [], [list(values)])
        return (count, *mean), (count, *mean)

    columns = "count long, " + ", ".join(f"{c} double" for c in fractions)
    return fold_in_order(samples, ["device", "kind"], fractions, fold, columns, delay)


def stability_stream(frames: DataFrame, delay: str = "1 hour", move: float = 3.0) -> DataFrame:
    """session_id, event_id, late, run of every frame, in event order."""

    def fold(state: tuple | None, values: tuple) -> tuple[tuple, tuple]:
        run, last = (state[0], state[1:]) if state else (0, (0.0, 0.0, 0.0))
        left, top, width, fill = values
        if left is None or fill is None or not 15 < fill < 92:
            run = 0
        else:
            now = (left, top, width)
            run = min(run + 1, LONGEST_RUN) if run and all(a is not None and b is not None and abs(a - b) < move for a, b in zip(now, last, strict=True)) else 1
            last = now
        return (run, *last), (run,)

    return fold_in_order(frames, ["session_id"], ["x_left", "top", "width", "fill"], fold, "run int", delay)


class FirstOnce(StatefulProcessor):
    """The first row of every key that was never seen before, by an order within a batch; all that is kept of a key is that it was seen."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        if not self.seen.exists():
            self.seen.update((True,))
            pdf = pd.concat(list(rows))
            yield (pdf.sort_values(self.order, kind="stable") if self.order else pdf).head(1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def catalog_stream(listing: DataFrame, out: str, checkpoint: str, key: str = "card_id", order: list[str] | None = None, known: DataFrame | None = None) -> StreamingQuery:
    """Adds the new cards of every landed listing file to the parquet catalog at out; each batch has its own folder, so a
    batch that runs again replaces what it wrote.

    Which cards are known stands in the state store, so a batch reads nothing of the catalog, however large it is. Of rows of one card in a batch,
    the first by order is taken. known: cards (a frame with the key) that are there before the stream's first batch.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = known.select(key).distinct().groupBy(key) if known is not None else None
    fresh = listing.groupBy(key).transformWithStateInPandas(FirstOnce(list(order or [])), listing.schema, "Append", "None", initialState=before)
    return started(fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True), listing.sparkSession)
