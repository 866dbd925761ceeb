"""Exact nearest cards by cosine with blocks left out: a block around a pivot is skipped where its angle bound says that nothing in it can count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import similarity_confidence
from ..sources.shared import arrow_ready, stored
from .similarity import BLOCK, best_of_block

#: Vectors of the gallery that blocks are made around, and what a bound may be wrong by through rounding.
PIVOTS, SLACK = 256, 1e-9
#: Pairs of a query and a block that a task holds at once before it hands them on.
SENT = 8192


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of them are not zero."""
    m = np.array(vectors, dtype=np.float64).reshape(len(vectors), dim)
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1)[:, None], n > 0


class Blocks:
    """What tasks know of all blocks: pivot, largest angle to it, number of cards. A few numbers for each BLOCK cards, and the pivots."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.names = np.array([r.block for r in rows], dtype=np.int64)
        self.pivot = np.array([r.pivot for r in rows], dtype=np.int64)
        self.angle = np.array([r.angle for r in rows])
        self.n = np.array([r.n for r in rows], dtype=np.int64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x blocks) the greatest similarity that a card of the block can have."""
        angles = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))[:, self.pivot]
        return np.cos(np.maximum(0, angles - self.angle))

    def nearest(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Places of the blocks with the highest bounds that hold k cards together."""
        order = np.argsort(-bounds, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1]


def blocks_around(gallery: DataFrame, pivots: int, size: int, count: int) -> tuple[DataFrame, np.ndarray]:
    """block, pivot, angle, n, ids, vectors: every card in a block of the pivot nearest to it; and the pivots, a sample by hashes of ids."""
    rows = gallery.select(F.col("card_id").cast("string").alias("card_id"), "embedding")
    sample = [r.embedding for r in rows.orderBy(F.xxhash64("card_id"), "card_id").limit(pivots).collect()]
    dim = len(sample[0]) if sample else 1
    marks, good = unit_rows(sample, dim)
    marks = marks[good]
    shared = gallery.sparkSession.sparkContext.broadcast(marks)  # at most `pivots` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value):
                m, ok = unit_rows(batch.column("embedding").to_pylist(), dim)
                sims = np.clip(m[ok] @ shared.value.T, -1, 1)
                near = sims.argmax(axis=1)
                ids = batch.column("card_id").filter(pa.array(ok))
                raw = pa.array([v.tobytes() for v in m[ok]], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(np.arccos(sims[np.arange(len(near)), near])), raw], names=["card_id", "pivot", "angle", "vector"])

    dealt = stored(arrow_ready(rows).mapInArrow(run, "card_id string, pivot int, angle double, vector binary"), "dealt")
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # a row for each pivot
    block = F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("card_id"), F.col("parts"))
    packed = dealt.join(F.broadcast(sizes), "pivot").groupBy(block.alias("block"), "pivot").agg(
        F.max("angle").alias("angle"), F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("card_id", "vector"))).alias("cards")
    )
    return stored(packed.select("block", "pivot", "angle", "n", F.col("cards.card_id").alias("ids"), F.col("cards.vector").alias("vectors")), "blocks"), marks


def cosine_topk_pruned(queries: DataFrame, gallery: DataFrame, k: int = 10, pivots: int = PIVOTS, size: int = BLOCK, met: list | None = None) -> DataFrame:
    """query_id, card_id, similarity, rank, confidence: the rows of cosine_topk, without most of its products where vectors lie in clusters.

    A query first meets the blocks with the highest bounds that hold k cards; their k-th best similarity is a limit that every other
    block's bound must reach. So nothing that could count is left out. met: gets the numbers of (query, block) pairs that met, and of all.
    """
    spark, schema = queries.sparkSession, "query_id long, card_id string, similarity double"
    blocks, marks = blocks_around(gallery, pivots, size, gallery.count())
    shared = spark.sparkContext.broadcast(Blocks(marks, blocks.select("block", "pivot", "angle", "n").orderBy("block").collect()))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    n_queries = asked.count()
    dim = marks.shape[1]

    def sent(rows: DataFrame, first: bool) -> DataFrame:
        """query_id, vector, block: the blocks that queries go to, at first or then."""

        def flat(made: list) -> pa.RecordBatch:
            n = [len(b) for _, _, b in made]
            q, v = pa.array([i for i, _, _ in made], pa.int64()), pa.array([x for _, x, _ in made], pa.binary())
            at = pa.array(np.repeat(np.arange(len(made)), n))
            b = pa.array(np.concatenate([b for _, _, b in made]) if made else [], pa.int64())
            return pa.RecordBatch.from_arrays([q.take(at), v.take(at), b], names=["query_id", "vector", "block"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = shared.value
                if not batch.num_rows or not len(known.names):
                    continue
                m, ok = unit_rows(batch.column("embedding").to_pylist(), dim)
                ids, bounds = batch.column("query_id").to_pylist(), known.bounds(m)
                limits = batch.column("limit").to_pylist()
                made, size = [], 0
                for j in np.flatnonzero(ok).tolist():
                    near = known.nearest(bounds[j], k)
                    if not first:
                        wanted = bounds[j] >= (-2.0 if limits[j] is None else limits[j] - SLACK)
                        wanted[near] = False
                        near = np.flatnonzero(wanted)
                    made.append((ids[j], m[j].tobytes(), known.names[near]))
                    size += len(near)
                    if size >= SENT:
                        yield flat(made)
                        made, size = [], 0
                yield flat(made)

        return arrow_ready(rows).mapInArrow(run, "query_id long, vector binary, block long")

    def best(pairs: DataFrame) -> DataFrame:
        """The k best of each pair of a query and a block; queries of one block go together, up to BLOCK on average.

        The files of pairs are small, as a query's vector stands in them once for all its blocks, but the rows are not: both sides are
        shuffled, whatever their files' sizes say, since a broadcast would gather them in the driver.
        """
        group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // BLOCK))))
        together = pairs.groupBy("block", group.alias("g")).agg(F.collect_list("query_id").alias("qs"), F.collect_list("vector").alias("vs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qs, vs, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("qs", "vs", "ids", "vectors")), strict=True):
                    q, g = (np.frombuffer(b"".join(x), np.float64).reshape(len(x), dim) for x in (vs, vectors))
                    found = best_of_block(q, np.array(ids, dtype=object), g, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, (s, _) in zip(qs, found, strict=True) for _ in s], pa.int64()), pa.array([c for _, cs in found for c in cs], pa.string()), pa.array([float(x) for s, _ in found for x in s])],
                        names=["query_id", "card_id", "similarity"],
                    )

        return together.hint("merge").join(blocks.select("block", "ids", "vectors"), "block").select("qs", "vs", "ids", "vectors").mapInArrow(run, schema)

    none = F.lit(None).cast("double").alias("limit")
    first_pairs = stored(sent(asked.select("query_id", "embedding", none), True), "pairs")
    first = stored(best(first_pairs), "near")
    limits = first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("similarity"), False), F.lit(k - 1)).alias("limit"))
    later_pairs = stored(sent(asked.hint("merge").join(limits, "query_id", "left").select("query_id", "embedding", "limit"), False), "pairs")
    if met is not None:
        met += [first_pairs.count() + later_pairs.count(), n_queries * blocks.count()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "card_id")).cast("long")
    every = first.unionByName(best(later_pairs)).withColumn("rank", rank)
    return every.where(F.col("rank") <= k).withColumn("confidence", similarity_confidence(F.col("similarity")))
