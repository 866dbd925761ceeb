"""N-gram Jaccard join: near-duplicate documents by five-word shingles, similarity 0.8 or more.

1. Every text becomes a set of hashed shingles and a MinHash signature. Equal sets form one class of copies
   (an aggregation, so thousands of copies cost one row); all that follows works on one text for each class.
2. Signatures are cut into bands; texts that share a band value meet in a bucket. 32 bands of 4 values miss a pair
   of similarity 0.8 with probability 5e-8. Buckets with the same members are looked at once.
3. Buckets are dealt to tasks in blocks: about BLOCK texts against BLOCK texts (a signature is small), fewer where texts are long (BLOCK_SHINGLES), so
   none is ever gathered whole; large buckets are split by size class before, since texts whose sizes differ by more than 1 / threshold
   can't be alike. In a block, MinHash values are compared step by step; a pair is dropped as soon as the posterior
   probability (uniform prior, binomial likelihood) that its similarity reaches the threshold falls below TOLERANCE. A pair is
   judged only in its first common band. Blocks hold signatures only; shingles are made and sent just for the texts
   that have a surviving pair, to the blocks where they have it, and there the pairs are verified exactly.
4. A block returns no pairs, only each text's number of links and a spanning forest of the links found. Connected
   components of these give the classes.

Every row is a document of its own. Defined cases: a text of fewer than five words is one shingle; texts without words are alike
only if their strings are equal (null counts as empty); a very long text is shingled whole; rows that repeat a doc_id, with the same
text or another, and rows without one are compared and linked like any others; class_id is the least doc_id of the class, null if
none of its rows has one; an empty table gives no rows; extra columns are ignored, also those with the names of results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, by_ids, fresh, map_rows, remove_saved, saved, spark_schema, table, written

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BANDS = 32
STEP = 16
TOLERANCE = 1e-6
#: Texts, and shingles of texts, in one side of a block, on average.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Slots of a bucket up to which all meet, and the least width of a size class (natural logarithm), which bounds their number.
SPLIT = 2
LEAST_WIDTH = 0.05
#: Pairs of a block that are compared at once (1 kB each), and words whose hashes a task remembers.
PAIRS = 1 << 14
MEMO = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_SEEDS = np.random.default_rng(20240101).integers(1, 2**63, size=(2, HASHES), dtype=np.uint64)
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are remembered by the task."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, text: str | None, size: int = SHINGLE) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        names = [memo.get(w) for w in words]
        if None in names:
            for k, (w, name) in enumerate(zip(words, names, strict=True)):
                if name is None:
                    names[k] = memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        names = np.array(names, dtype=np.uint64)
        n = max(len(names) - size + 1, min(1, len(names)))
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(min(size, len(names))):
            rolled = rolled * _MIX + names[k : k + n]
        return np.unique(scramble(rolled))


def digest(shingles: np.ndarray, text: str | None) -> bytes:
    """Equal for equal shingle sets; for texts without words, for equal texts."""
    raw = shingles.tobytes() if len(shingles) else b"text:" + (text or "").encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        least = np.minimum(least, ((_SEEDS[0][:, None] | np.uint64(1)) * part + _SEEDS[1][:, None] >> np.uint64(32)).min(axis=1))
    return least.astype("<u4")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes that name a row by both; equal rows share them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())


def row_key() -> tuple[Column, Column]:
    id_ = F.col("doc_id").cast("long")
    return F.xxhash64(id_, "text").alias("key"), F.xxhash64(F.lit(7), "text", id_).alias("key2")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, key2, set_id (16 bytes), n_shingles, signature of every document."""

    def make():
        shingles = Shingles()
        known: dict[bytes, bytes] = {}

        def row(doc_id, key, key2, text):
            own = shingles.of(text)
            name = digest(own, text)
            if name not in known:
                if len(known) > 2000:
                    known.clear()
                known[name] = signature(own).tobytes()
            yield doc_id, key, key2, name, len(own), known[name]

        return row

    schema = "doc_id long, key long, key2 long, set_id binary, n_shingles long, signature binary"
    return map_rows(keyed(docs), ["doc_id", "key", "key2", "text"], make, schema)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones with which a pair stays) after each step.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m of n equal values, and it exceeds
    the threshold with the probability that a Binomial(n + 1, threshold) is at most m.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return out


def bands_of(classes: DataFrame) -> DataFrame:
    """rep, n_shingles, band, value for each band of each signature."""
    width = HASHES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u4").reshape(-1, BANDS, width).astype(np.uint64)
            value = np.zeros(sig.shape[:2], dtype=np.uint64)
            for k in range(width):
                value = scramble(value * _MIX + sig[:, :, k])
            reps, sizes = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("rep", "n_shingles"))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps), pa.array(sizes), pa.array(band), pa.array(value.ravel().view(np.int64))], names=["rep", "n_shingles", "band", "value"]
            )

    return arrow_ready(classes).select("rep", "n_shingles", "signature").mapInArrow(run, "rep long, n_shingles long, band int, value long")


def surviving_pairs(rows: list[dict], threshold: float, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one block that outlive the MinHash comparison and have their first common band here.

    rows: side ('a', 'b' or 'both'), rep, band, n_shingles, signature. Two sides are compared with each
    other only; 'both' rows with each other.
    """
    sides = np.array([r["side"] for r in rows])
    left = np.flatnonzero(sides != "b")
    right = left if (sides == "both").any() else np.flatnonzero(sides == "b")
    sig = np.frombuffer(b"".join(r["signature"] for r in rows), dtype="<u4").reshape(len(rows), HASHES)
    size = np.array([r["n_shingles"] for r in rows])
    width = HASHES // BANDS
    found = []
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
        keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        if right is left:
            keep &= i < j
        i, j = i[keep], j[keep]
        equal = np.zeros(len(i), dtype=np.int64)
        for n, least in steps:
            equal += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1)
            stay = equal >= least
            i, j, equal = i[stay], j[stay], equal[stay]
        common = (sig[i].reshape(-1, BANDS, width) == sig[j].reshape(-1, BANDS, width)).all(axis=2)
        first = common.argmax(axis=1) == rows[0]["band"]
        found.append((i[first], j[first]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def linked_in_block(rows: list[dict], threshold: float, steps: list[tuple[int, int]]) -> tuple[dict, list]:
    """Links of one block: {rep: linked documents}, and edges of a spanning forest; rows have copies and shingles too."""
    links: dict[int, int] = {}
    parent: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    sets: dict[int, np.ndarray] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    i, j = surviving_pairs(rows, threshold, steps)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        for k in (a, b):
            if k not in sets:
                sets[k] = np.frombuffer(rows[k]["shingles"], dtype="<u8")
        x, y = sets[a], sets[b]
        both = len(x) + len(y) - len(np.union1d(x, y))
        if both >= threshold * (len(x) + len(y) - both) - 1e-9:
            ra, rb = rows[a]["rep"], rows[b]["rep"]
            links[ra] = links.get(ra, 0) + rows[b]["copies"]
            links[rb] = links.get(rb, 0) + rows[a]["copies"]
            if root(a) != root(b):
                parent[root(a)] = root(b)
                edges.append((ra, rb))
    return links, edges


BLOCK_KEY = ("bucket", "x", "y")


def by_block(blocks: DataFrame, columns: list[str], judge_one: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Gathers each block's rows (sorted, whole in a partition) and yields what judge_one makes of them."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = arrow_ready(blocks).select(*BLOCK_KEY, *columns).repartition(parts, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    fields = spark_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns_ = zip(*out, strict=True) if out else [[]] * len(fields)
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_, fields, strict=True)], schema=fields)
            out.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if (name := tuple(r[c] for c in BLOCK_KEY)) != key:
                    if len(rows) > 1:
                        out.extend(judge_one(rows))
                    key, rows = name, []
                rows.append(r)
            if len(out) > 10_000:
                yield flush()
        if len(rows) > 1:
            out.extend(judge_one(rows))
        yield flush()

    return ordered.mapInArrow(run, schema)


def survivors(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of blocks (without signatures) that have a surviving pair there."""

    def one(rows: list[dict]) -> Iterator[tuple]:
        i, j = surviving_pairs(rows, threshold, steps)
        for k in np.union1d(i, j).tolist():
            r = rows[k]
            yield r["bucket"], r["x"], r["y"], r["side"], r["rep"], r["band"]

    steps = least_matches(threshold)
    return by_block(blocks, ["side", "rep", "band", "n_shingles", "signature"], one, "bucket long, x long, y long, side string, rep long, band int")


def judge(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, links, other: a row for each text with links in a block (other null) and each forest edge (links null)."""

    def one(rows: list[dict]) -> Iterator[tuple]:
        links, edges = linked_in_block(rows, threshold, steps)
        for r, n in links.items():
            yield r, n, None
        for a, b in edges:
            yield a, None, b

    steps = least_matches(threshold)
    columns = ["side", "rep", "band", "copies", "n_shingles", "signature", "shingles"]
    return by_block(blocks, columns, one, "rep long, links long, other long")


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its connected component) for undirected edges a, b.

    Alternates two steps until nothing changes: every node's larger neighbours move to its least neighbour (or stay, if
    that is itself), then every node's smaller neighbours do. Each round is written to the shared folder, and the one before removed.
    """
    spark = edges.sparkSession

    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = saved(directed(edges), "edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        mark = written() - 1
        lower = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))  # of nodes that have a smaller neighbour
        large = saved(now.join(lower, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = saved(directed(small), "edges")
        remove_saved(spark, mark, keep=1)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, key2 of every row, class_id, n_links, and the key of the row that stands for the class (keep, keep2)."""
    sketched = saved(sketches(docs), "sketches")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2")
    classes = saved(
        sketched.groupBy("set_id").agg(
            F.min(who).alias("who"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ).withColumn("rep", F.monotonically_increasing_id()),  # fixed by being written
        "classes",
    )
    judged = saved(judge(_full_blocks(docs, classes, threshold), threshold), "judged")
    links = judged.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = component_labels(judged.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    labels = saved(labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct(), "labels")
    heads = labels.join(classes.select(F.col("rep").alias("node"), "who"), "node").groupBy("label").agg(F.min("who").alias("head"))
    headed = labels.join(heads, "label").select(F.col("node").alias("rep"), "head")
    named = classes.select("set_id", "rep", "copies", "who").join(links, "rep", "left").join(headed, "rep", "left").withColumn("head", F.coalesce("head", "who")).select(
        "set_id", F.col("head.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("head.key").alias("keep"), F.col("head.key2").alias("keep2"),
    )
    return sketched.select("doc_id", "key", "key2", "set_id").join(named, "set_id").drop("set_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the connected near-duplicates), n_links (other rows that reach the threshold)."""
    return classified(docs, threshold).select("doc_id", "class_id", "n_links")


def size_class(n_shingles: str, threshold: float) -> Column:
    """Texts that reach the threshold are in the same class or in neighbouring ones: their sizes differ by 1 / threshold at most."""
    width = max(-math.log(threshold) + 1e-9, LEAST_WIDTH)
    return F.floor(F.log(F.col(n_shingles)) / width).cast("int")


def _slots(n: str, size: str) -> Column:
    return F.least(F.col(n), F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES))).cast("int")


def _blocks(classes: DataFrame, threshold: float) -> DataFrame:
    """Block rows: every pair of texts that share a bucket meets in exactly one block of each of its buckets.

    Buckets of more than SPLIT slots are split by size class first: a class meets itself and its neighbours only.
    """
    bands = bands_of(classes.where("n_shingles > 0"))
    member = F.xxhash64("rep")
    buckets = bands.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.sum(F.shiftright(member, 20)).alias("sum"), F.bit_xor(member).alias("xor")
    ).where("n > 1")
    first = buckets.groupBy("n", "size", "sum", "xor").agg(F.min(F.struct("band", "value")).alias("key")).select("n", "size", "key.band", "key.value")
    large = _slots("n", "size") > SPLIT
    members = saved(
        bands.join(first, ["band", "value"]).select(
            "rep", "n_shingles", "band", F.xxhash64("band", "value").alias("bucket"), F.when(large, size_class("n_shingles", threshold)).alias("cls"), _slots("n", "size").alias("slots")
        ),
        "members",
    )
    plain = members.where("cls is null").withColumn("cls", F.lit(0)).withColumn("near", F.create_map(F.lit(0), F.col("slots")))
    by_class = members.where("cls is not null").groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    near = by_class.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("cls", _slots("n", "size")))).alias("near"))
    split = members.where("cls is not null").join(near, "bucket")
    rows = plain.select("rep", "band", "bucket", "cls", "near").unionByName(split.select("rep", "band", "bucket", "cls", "near"))

    def place(cls: Column, slot: Column) -> Column:
        return F.shiftleft(cls.cast("long"), 32) + slot

    own = place(F.col("cls"), F.pmod(F.xxhash64("rep", F.lit(7)), F.col("near")[F.col("cls")]))
    meets = F.filter(F.array(*(F.col("cls") + d for d in (-1, 0, 1))), lambda c: F.map_contains_key("near", c))
    others = F.flatten(F.transform(meets, lambda c: F.transform(F.sequence(F.lit(0), F.col("near")[c] - 1), lambda k: place(c, k))))
    return rows.select("rep", "band", "bucket", own.alias("own"), F.explode(others).alias("other")).select(
        "rep", "band", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), "both").when(F.col("own") < F.col("other"), "a").otherwise("b").alias("side"),
    )


def _full_blocks(docs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Block rows of the texts with surviving pairs, with copies, signature and shingles."""
    alive = saved(survivors(_blocks(classes, threshold).join(classes.select("rep", "n_shingles", "signature"), "rep"), threshold), "survivors")
    wanted = saved(classes.join(alive.select("rep").distinct(), "rep", "left_semi"), "wanted")
    texts = by_ids(keyed(docs), wanted.select("who.key").distinct(), "key", "left_semi")

    def make():
        shingles = Shingles()

        def row(text):
            own = shingles.of(text)
            yield digest(own, text), own.tobytes()

        return row

    sets = map_rows(texts, ["text"], make, "set_id binary, shingles binary").dropDuplicates(["set_id"])
    return alive.join(sets.join(wanted, "set_id"), "rep")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class, one row: that with the least doc_id (rows without one come last); of equal rows, one."""
    rows = classified(docs, threshold).select("key", "key2", ((F.col("key") == F.col("keep")) & (F.col("key2") == F.col("keep2"))).alias("kept"))
    counted = saved(rows.groupBy("key", "key2", "kept").agg(F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "not_kept_once")
    names = [fresh(docs, "_key"), fresh(docs, "_key2")]
    named = docs.withColumns(dict(zip(names, row_key(), strict=True)))
    gone, again = (counted.where(c).select(F.col("key").alias(names[0]), F.col("key2").alias(names[1])) for c in ("not kept", "kept"))
    left = by_ids(named, gone, names, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = by_ids(left, again, names, "left_semi").dropDuplicates(names)
    return by_ids(left, again, names, "left_anti").unionByName(once).select(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
