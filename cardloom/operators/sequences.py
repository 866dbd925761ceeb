"""Ordered per-key work: running calibration means and runs of stable frames.

Neither puts a key into one task. Rows are cut into pieces, ranges of (key, order), so a key with most of the rows is spread over
many pieces; each piece is worked alone and leaves a small summary of each of its keys, and the summaries of a key are combined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Samples that the history of a calibration weighs at most, and length at which a stable run stops counting.
MEMORY, LONGEST_RUN = 5, 15
#: Rows of a piece, on average.
PER_PIECE = 100_000


def in_pieces(df: DataFrame, order: tuple[str, ...], rows: int = PER_PIECE) -> DataFrame:
    """df with _piece, the number of its range of the order's columns. Stored, so that all that is made of it sees the same ranges."""
    parts = max(1, -(-df.count() // rows))
    return stored(df.repartitionByRange(parts, *order).withColumn("_piece", F.spark_partition_id()), "pieces")


def calibrate_bounds(samples: DataFrame, fractions: list[str], keys: tuple[str, ...] = ("device", "kind"), order: str = "event_id", rows: int = PER_PIECE) -> DataFrame:
    """keys, count and the running mean of each fraction, as if samples were folded in order.

    A fold gives history the weight min(count, 5) and a new sample 1. Unrolled over n samples: up to 6, all weigh 1/n;
    beyond, sample i weighs (1/6)(5/6)^(n-i), the first six (1/6)(5/6)^(n-6) each. A piece's summary is its count, its first six samples
    and its sum faded to its end; pieces are combined by fading their sums by what comes after them.
    """
    full = MEMORY + 1
    fade = lambda e: F.pow(F.lit(MEMORY / full), e)
    own = Window.partitionBy("_piece", *keys)
    pieces = in_pieces(samples.select(*keys, order, *fractions), (*keys, order), rows)
    numbered = pieces.withColumns({"_n": F.count(F.lit(1)).over(own), "_i": F.row_number().over(own.orderBy(order))})
    head = F.when(F.col("_i") <= full, F.struct("_i", *fractions))
    faded = [F.sum(F.col(c) * fade(F.col("_n") - F.col("_i"))).alias(f"_sum_{c}") for c in fractions]
    summary = numbered.groupBy("_piece", *keys).agg(F.max("_n").alias("_n"), F.collect_list(head).alias("_head"), *faded)

    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece")) - F.col("_n")
    placed = summary.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    firsts = F.filter("_head", lambda h: F.col("_before") + h["_i"] <= full)
    total = lambda value: F.aggregate("_firsts", F.lit(0.0), lambda s, h: s + value(h))
    placed = placed.withColumn("_firsts", firsts).withColumns(
        {f"_plain_{c}": total(lambda h, c=c: h[c]) for c in fractions}
        | {f"_old_{c}": total(lambda h, c=c: h[c] * fade(F.col("_all") - F.col("_before") - h["_i"])) for c in fractions}
        | {f"_sum_{c}": F.col(f"_sum_{c}") * fade(F.col("_all") - F.col("_before") - F.col("_n")) for c in fractions}
    )
    n = F.first("_all")
    # the first six weigh alike, not by their age
    late = lambda c: (F.sum(f"_sum_{c}") - F.sum(f"_old_{c}") + fade(n - full) * F.sum(f"_plain_{c}")) / full
    return placed.groupBy(*keys).agg(n.alias("count"), *(F.when(n <= full, F.sum(f"_plain_{c}") / n).otherwise(late(c)).alias(c) for c in fractions))


def frame_counts(left: Column, fill: Column) -> Column:
    """A frame counts if the outline was found and fills more than 15 and less than 92 percent."""
    return F.coalesce(left.isNotNull() & (fill > 15) & (fill < 92), F.lit(False))


def stable_runs(frames: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "event_id"), move: float = 3.0, rows: int = PER_PIECE) -> DataFrame:
    """frames with run: how many counting frames in a row, this one included, have each moved less than `move` percent
    in left, top and width since the frame before; 15 at most; 0 on a frame that does not count.

    frames: x_left, top, width, fill. A segmented scan: a piece knows where runs break in it, given the frame before it; what it
    leaves (its last frame, its rows, the run at its end) is composed over the pieces before each piece.
    """
    places = ("x_left", "top", "width")
    counts = frame_counts(F.col("x_left"), F.col("fill"))
    pieces = in_pieces(frames.withColumn("_now", F.struct(counts.alias("ok"), *places)), (key, *order), rows)
    last = F.struct(*order)
    within = Window.partitionBy("_piece", key).orderBy(*order)
    across = Window.partitionBy(key).orderBy("_piece")

    ends = pieces.groupBy("_piece", key).agg(F.max_by("_now", last).alias("_end"))
    entered = ends.select("_piece", key, F.lag("_end").over(across).alias("_entry"))
    p, e = pieces.alias("p"), entered.alias("e")
    joined = p.join(e, (F.col("p._piece") == F.col("e._piece")) & F.col(f"p.{key}").eqNullSafe(F.col(f"e.{key}"))).select("p.*", "_entry")

    before = F.coalesce(F.lag("_now").over(within), F.col("_entry"))
    near = F.lit(True)
    for c in places:
        near = near & (F.abs(F.col(f"_now.{c}") - F.col(f"_last.{c}")) < move)
    goes_on = F.coalesce(F.col("_now.ok") & F.col("_last.ok") & near, F.lit(False))
    islands = joined.withColumn("_last", before).withColumn("_breaks", F.sum(F.when(goes_on, 0).otherwise(1)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = stored(islands.withColumn("_place", F.row_number().over(Window.partitionBy("_piece", key, "_breaks").orderBy(*order))).drop("_last", "_entry"), "islands")

    left = placed.groupBy("_piece", key).agg(F.count(F.lit(1)).alias("_n"), F.max("_breaks").alias("_breaks"), F.max_by("_place", last).alias("_place"))
    so_far = left.withColumn("_rows", F.sum("_n").over(across))
    # rows since the last piece with a break, and the run which that piece ended with
    broken = F.last(F.when(F.col("_breaks") > 0, F.struct("_place", "_rows")), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = so_far.withColumn("_b", broken).select("_piece", key, (F.col("_b._place") + F.col("_rows") - F.col("_n") - F.col("_b._rows")).alias("_carried"))
    q, c = placed.alias("q"), carried.alias("c")
    met = q.join(c, (F.col("q._piece") == F.col("c._piece")) & F.col(f"q.{key}").eqNullSafe(F.col(f"c.{key}"))).select("q.*", "_carried")
    run = F.col("_place") + F.when(F.col("_breaks") == 0, F.coalesce("_carried", F.lit(0))).otherwise(0)
    return met.withColumn("run", F.when(F.col("_now.ok"), F.least(run, F.lit(LONGEST_RUN))).otherwise(0).cast("int")).drop("_piece", "_now", "_breaks", "_place", "_carried")
