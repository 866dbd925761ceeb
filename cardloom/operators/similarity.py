"""Nearest cards by cosine similarity and by Hamming distance of perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scores import array_median, hamming_confidence, let, similarity_confidence
from ..functions.text import card_id_parts, match_image_url
from ..sources.shared import stored

#: Gallery vectors in one block row, and most bytes of a gallery that is sent to every task whole.
BLOCK = 4096
BROADCAST_BYTES = 256_000_000
#: Bits of one of the four parts of a hash, and the largest radius that the index of parts is for.
PART_BITS, MOST_RADIUS = 16, 15


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_pairs(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """query_id, card_id, similarity of all pairs, in SQL: the twin of cosine_topk for tests; Q x N rows exist here."""
    q, g = queries.select("query_id", F.col("embedding").alias("qe")), gallery.select("card_id", F.col("embedding").alias("ge"))
    return q.crossJoin(g).select("query_id", "card_id", cosine(F.col("qe"), F.col("ge")).alias("similarity")).where("similarity is not null")


def blocks_of(gallery: DataFrame, count: int, size: int = BLOCK) -> DataFrame:
    """ids, vectors: gallery vectors (count of them) of unit length, packed as float64 matrices of at most size rows on average.

    Zero vectors drop out.
    """
    rows = gallery.select("card_id", "embedding")
    n = max(1, -(-count // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def flush() -> pa.RecordBatch:
            matrix = np.vstack(parts)
            norms = np.linalg.norm(matrix, axis=1)
            good = norms > 0
            unit = (matrix[good] / norms[good, None]).astype("<f8")
            return pa.RecordBatch.from_arrays([pa.array([[i for i, k in zip(ids, good, strict=True) if k]], pa.list_(pa.string())), pa.array([unit.tobytes()], pa.binary())], names=["ids", "vectors"])

        for batch in batches:
            if batch.num_rows:
                ids += batch.column("card_id").to_pylist()
                parts.append(np.array(batch.column("embedding").to_pylist(), dtype=np.float64))
            if len(ids) >= size:
                yield flush()
                ids, parts = [], []
        if ids:
            yield flush()

    return rows.select(F.col("card_id").cast("string").alias("card_id"), "embedding").repartition(n).mapInArrow(pack, "ids array<string>, vectors binary")


def best_of_block(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query row the k best of a block: (similarities, ids), ties by id."""
    sims = query @ vectors.T
    out = []
    for row in sims:
        if len(row) > k:
            cut = np.partition(row, -k)[-k]
            keep = np.flatnonzero(row >= cut - 1e-12)
        else:
            keep = np.arange(len(row))
        order = sorted(keep.tolist(), key=lambda j: (-round(float(row[j]), 12), ids[j]))[:k]
        out.append((row[order], ids[order]))
    return out


def cosine_topk(queries: DataFrame, gallery: DataFrame, k: int = 10, cards: DataFrame | None = None) -> DataFrame:
    """query_id, card_id, similarity, rank, confidence of every query's k best cards (ties by card id).

    queries: query_id, embedding; gallery: card_id, embedding. The gallery is packed into blocks; a query's batch is
    multiplied with each block and k rows for each (query, block) go on, so Q x N rows never exist. A gallery up to
    BROADCAST_BYTES is sent to the tasks block by block; a larger one is paired with batches of queries by a join of
    block rows. cards: card_id, name, set_id, local_id to enrich the result with (missing ones fall back on the id).
    """
    count, numbers = gallery.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    blocks, size = blocks_of(gallery, count), 8 * numbers
    packed = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")

    def unit(vectors: list) -> np.ndarray:
        m = np.array(vectors, dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

    def rows(query_ids: list, m: np.ndarray, found: list) -> pa.RecordBatch | None:
        good = [j for j in range(len(query_ids)) if not np.isnan(m[j]).any()]
        q = [query_ids[j] for j in good for _ in found[j][0]]
        sims = [float(x) for j in good for x in found[j][0]]
        ids = [str(x) for j in good for x in found[j][1]]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.string()), pa.array(sims, pa.float64())], names=["query_id", "card_id", "similarity"])

    schema = "query_id long, card_id string, similarity double"
    if size <= BROADCAST_BYTES:
        held = [(np.array(r.ids, dtype=object), r.vectors) for r in blocks.collect()]  # counted above
        shared = queries.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = unit(batch.column("embedding").to_pylist())
                best = [(np.empty(0), np.empty(0, dtype=object))] * len(m)
                for ids, raw in shared.value:
                    vectors = np.frombuffer(raw, "<f8").reshape(len(ids), -1)
                    for j, (s, i) in enumerate(best_of_block(m, ids, vectors, k)):
                        s, i = np.concatenate([best[j][0], s]), np.concatenate([best[j][1], i])
                        order = sorted(range(len(s)), key=lambda x: (-round(float(s[x]), 12), i[x]))[:k]
                        best[j] = (s[order], i[order])
                yield rows(batch.column("query_id").to_pylist(), m, best)

        partial = packed.mapInArrow(run, schema)
    else:
        grouped = packed.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(max(1, packed.count() // BLOCK + 1)))).groupBy("g").agg(F.collect_list("query_id").alias("qs"), F.collect_list("embedding").alias("es"))

        def pair(batches):
            for batch in batches:
                for qs, es, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("qs", "es", "ids", "vectors")), strict=True):
                    m = unit(es)
                    yield rows(qs, m, best_of_block(m, np.array(ids, dtype=object), np.frombuffer(raw, "<f8").reshape(len(ids), -1), k))

        partial = grouped.crossJoin(blocks).mapInArrow(pair, schema)  # of blocks, not of vectors
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "card_id")).cast("long")
    top = partial.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("confidence", similarity_confidence(F.col("similarity")))
    return enrich(top, cards) if cards is not None else top


def enrich(matches: DataFrame, cards: DataFrame) -> DataFrame:
    """matches with name, set, number and image; what a card lacks comes from the parts of its id."""
    parts = card_id_parts(F.col("card_id"))
    named = matches.join(cards.select("card_id", F.col("name").alias("_n"), F.col("set_id").alias("_s"), F.col("local_id").alias("_l")), "card_id", "left")
    out = named.withColumns({"name": F.coalesce("_n", parts["name"]), "set_id": F.coalesce("_s", parts["set"]), "number": F.coalesce("_l", parts["number"])}).drop("_n", "_s", "_l")
    return out.withColumn("image", match_image_url(F.col("set_id"), F.col("number")))


def match_status(queries: DataFrame, matches: DataFrame, confidence: str = "confidence") -> DataFrame:
    """query_id, status of every query: by its best match; unknown without one."""
    best = matches.where("rank = 1").select("query_id", F.col(confidence).alias("_c"))
    status = F.when(F.col("_c") == "high", "matched").when(F.col("_c") == "medium", "ambiguous").otherwise("unknown")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", status.alias("status"))


def hash_of_block(block: Column) -> Column:
    """16 hex digits of 64 values of an 8x8 frequency block: without the first, bit i says value i exceeds their median;
    the last bit is 0."""

    def bits(x: Column) -> Column:
        return let(array_median(x), lambda m: F.concat(F.array_join(F.transform(x, lambda v: F.when(v > m, "1").otherwise("0")), ""), F.lit("0")))

    rest = F.transform(F.slice(block, 2, 63), lambda v: v.cast("double"))
    return let(let(rest, bits), lambda b: F.lower(F.concat(*(F.lpad(F.conv(F.substring(b, 1 + 16 * k, 16), 2, 16), 4, "0") for k in range(4)))))


def hash_halves(hash_: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a hash as longs; a hash of another length is an error."""
    whole = F.when(F.length(hash_) == 16, hash_).otherwise(F.raise_error(F.concat(F.lit("not a 16-digit hash: "), F.coalesce(hash_, F.lit("null")))))
    return F.conv(F.substring(whole, 1, 8), 16, 10).cast("long"), F.conv(F.substring(whole, 9, 8), 16, 10).cast("long")


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def _halved(df: DataFrame, key: str, prefix: str) -> DataFrame:
    hi, lo = hash_halves(F.col("hash"))
    return df.select(key, hi.alias(f"{prefix}hi"), lo.alias(f"{prefix}lo"))


def hamming_topn(queries: DataFrame, cards: DataFrame, n: int = 5) -> DataFrame:
    """query_id, card_id, distance, rank, confidence of every query's n nearest cards (ties by card id).

    Every query meets every card's 16 bytes, as blocks of queries against blocks of cards: the n best of each
    (query, block) go on, so Q x N rows never exist. Card blocks up to BROADCAST_BYTES are sent to every task whole.
    """
    q, c = _halved(queries, "query_id", "q"), _halved(cards, "card_id", "c")
    n_queries, n_cards = q.count(), c.count()

    def packed(df: DataFrame, key: str, prefix: str, blocks: int) -> DataFrame:
        item = F.struct(key, f"{prefix}hi", f"{prefix}lo")
        listed = df.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b")).agg(F.array_sort(F.collect_list(item)).alias("l"))
        return listed.select(F.col("_b").alias(f"{prefix}group"), *(F.col(f"l.{x}").alias(x) for x in (key, f"{prefix}hi", f"{prefix}lo")))

    few = min(queries.sparkSession.sparkContext.defaultParallelism, -(-n_queries // 64))
    n_groups = max(1, few, -(-n_queries // BLOCK))
    groups = packed(q, "query_id", "q", n_groups).repartition(n_groups)  # packed rows are small and would be coalesced into one task
    blocks = packed(c, "card_id", "c", max(1, -(-n_cards // BLOCK)))
    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("card_id", c.schema["card_id"].dataType), StructField("distance", IntegerType())])

    def bits(batch: pa.RecordBatch, row: int, prefix: str) -> np.ndarray:
        hi, lo = (np.asarray(batch.column(f"{prefix}{x}")[row].values).astype(np.uint64) for x in ("hi", "lo"))
        return hi << np.uint64(32) | lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, query_ids, ids, d = None, None, None, None  # the n best so far of the group whose blocks come one after another

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([query_ids.take(pa.array(np.repeat(np.arange(len(d)), d.shape[1]))), ids, pa.array(d.ravel().astype(np.int32))], names=["query_id", "card_id", "distance"])

        for batch in batches:
            for row in range(batch.num_rows):
                card_ids, qs, cs = batch.column("card_id")[row].values, bits(batch, row, "q"), bits(batch, row, "c")
                places, k, best = np.arange(len(cs)), min(n, len(cs)), []
                for at in range(0, len(qs), 256):
                    # distance and place in one number: the cards are sorted by id, so ties go by id
                    keys = np.bitwise_count(qs[at : at + 256, None] ^ cs).astype(np.int64) * len(cs) + places
                    best.append(np.partition(keys, k - 1, axis=1)[:, :k])
                best = np.vstack(best)
                new_ids, new = card_ids.take(pa.array((best % len(cs)).ravel())), best // len(cs)
                if (name := batch.column("qgroup")[row].as_py()) != group:
                    if group is not None:
                        yield done()
                    group, query_ids, ids, d = name, batch.column("query_id")[row].values, new_ids, new
                    continue
                pool = pa.concat_arrays([ids, new_ids])
                at = np.hstack([np.arange(d.size).reshape(d.shape), d.size + np.arange(new.size).reshape(new.shape)])
                order = np.asarray(pc.rank(pool, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)[at]
                both = np.hstack([d, new])
                keep = np.argsort(both * (len(pool) + 1) + order, axis=1)[:, :n]
                d, ids = np.take_along_axis(both, keep, 1), pool.take(pa.array(np.take_along_axis(at, keep, 1).ravel()))
        if group is not None:
            yield done()

    small = 24 * n_cards <= BROADCAST_BYTES
    near = groups.crossJoin(F.broadcast(blocks) if small else blocks).mapInArrow(run, schema)  # of blocks, not of hashes
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "card_id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("confidence", hamming_confidence(F.col("distance")))


def parts_of(hi: Column, lo: Column) -> Column:
    """The four 16-bit parts of a hash."""
    low = F.lit(0xFFFF).cast("long")
    return F.array(F.shiftright(hi, 16), hi.bitwiseAND(low), F.shiftright(lo, 16), lo.bitwiseAND(low))


def flip_masks(most: int) -> list[int]:
    """All 16-bit numbers with so many bits at most."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(PART_BITS), k)]


def radius_candidates(queries: DataFrame, cards: DataFrame, flips: int) -> DataFrame:
    """query_id, card_id, distance of the pairs that agree up to `flips` bits in one of four parts, each pair once.

    All pairs up to distance 4 * flips + 3 are among them: with more, every part would differ in flips + 1 bits at least. A card stands in four
    posting lists, by part and value; a query looks up the values near its own. Of random hashes 4 * (masks / 65536) of all pairs meet,
    with two flips 0.8 %. A pair that meets in several parts is kept for the first of them.
    """
    q, c = _halved(queries, "query_id", "q"), _halved(cards, "card_id", "c")
    masks = F.array(*(F.lit(m).cast("long") for m in flip_masks(flips)))
    asked = q.select("*", F.posexplode(parts_of(F.col("qhi"), F.col("qlo"))).alias("part", "own")).select("query_id", "qhi", "qlo", "part", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    posted = c.select("*", F.posexplode(parts_of(F.col("chi"), F.col("clo"))).alias("part", "value"))
    differ = F.zip_with(parts_of(F.col("qhi"), F.col("qlo")), parts_of(F.col("chi"), F.col("clo")), lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= flips)
    first = F.array_position(differ, F.lit(True)) - 1
    met = asked.join(posted, ["part", "value"]).where(first == F.col("part"))
    return met.select("query_id", "card_id", hamming((F.col("qhi"), F.col("qlo")), (F.col("chi"), F.col("clo"))).alias("distance"))


def hamming_within(queries: DataFrame, cards: DataFrame, max_distance: int = 8) -> DataFrame:
    """query_id, card_id, distance of all pairs up to max_distance (at most MOST_RADIUS), from the radius index."""
    if max_distance > MOST_RADIUS:
        raise ValueError(f"the index is for distances up to {MOST_RADIUS}")
    return radius_candidates(queries, cards, max_distance // 4).where(F.col("distance") <= max_distance)


def hamming_topn_near(queries: DataFrame, cards: DataFrame, n: int = 5, flips: int = 2) -> DataFrame:
    """The rows of hamming_topn by a growing radius: a query that has n cards within a radius has its n nearest there, so it stops.

    The radius grows by four with each flip; queries whose n-th card is farther than the last radius are asked against the blocks of all
    cards. For catalogs in which most queries have several near cards.
    """
    left, found = stored(queries.select("query_id", "hash"), "asked"), []
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "card_id")).cast("long")
    for k in range(flips + 1):
        near = radius_candidates(left, cards, k).where(F.col("distance") <= 4 * k + 3).withColumn("rank", nearest).where(F.col("rank") <= n)
        near = stored(near, "near")
        done = near.where(F.col("rank") == n).select("query_id")
        found.append(near.join(done, "query_id", "left_semi"))
        left = stored(left.join(done, "query_id", "left_anti"), "asked")
        if left.isEmpty():
            break
    else:
        found.append(hamming_topn(left, cards, n).select("query_id", "card_id", "distance", "rank"))
    return reduce(DataFrame.unionByName, found).withColumn("confidence", hamming_confidence(F.col("distance")))


def group_by_artwork(matches: DataFrame, threshold: int = 3) -> DataFrame:
    """query_id, name, distance, confidence, primary_card, variants, variant_count: greedy groups of one query's matches.

    matches: query_id, card_id, name, distance, rank (the few best of each query). The seed is the first unused match;
    its group are the unused ones of the same name (any case) within the threshold of the seed's distance.
    """
    item = F.struct("rank", "distance", "card_id", "name")
    listed = matches.groupBy("query_id", F.lower("name").alias("low")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<struct<seed:int,rank:int,distance:int,card_id:string,name:string>>")

    def add(groups: Column, x: Column) -> Column:
        # sorted by distance: x belongs to the newest group or starts one
        last = F.when(F.size(groups) > 0, F.element_at(groups, -1)["seed"])
        fits = x["distance"] - last <= threshold
        seed = F.when(F.coalesce(fits, F.lit(False)), last).otherwise(x["distance"])
        return F.concat(groups, F.array(F.struct(seed.cast("int").alias("seed"), x["rank"].cast("int").alias("rank"), x["distance"].cast("int").alias("distance"), x["card_id"].alias("card_id"), x["name"].alias("name"))))

    folded = listed.select("query_id", "low", F.explode(F.aggregate("items", empty, add)).alias("g")).select("query_id", "low", "g.*")
    grouped = folded.groupBy("query_id", "low", "seed").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "card_id", "name"))).alias("v"))
    first = F.get(F.col("v"), F.lit(0))
    return grouped.select(
        "query_id", first["name"].alias("name"), first["distance"].alias("distance"), hamming_confidence(first["distance"]).alias("confidence"), first["card_id"].alias("primary_card"),
        F.transform("v", lambda x: x["card_id"]).alias("variants"), F.size("v").alias("variant_count"), first["rank"].alias("rank"),
    )


def flatten_variants(groups: DataFrame) -> DataFrame:
    """One row for each variant, with its group's confidence and size."""
    return groups.select("query_id", "confidence", "variant_count", F.explode_outer("variants").alias("card_id"))
