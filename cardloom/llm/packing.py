"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Exact-complement hashing. Only the histogram of piece lengths (at most `capacity` counts, whatever
the corpus holds) reaches the driver. There the sums of one, two and three of the lengths that occur are indexed once; every
length takes from the index, longest first, the combinations that fill its gap exactly, as long as the availability
counts last. What is left is placed best-fit, again on counts. Shorter combinations leave other rests to best-fit, so the
plan is made with up to three, two, one and no lengths for a gap, and the one with fewest sequences is taken
(of equal ones, that with more exact fills). The plan is a short list of (pattern of
lengths, how many sequences follow it). Spark numbers the pieces within their length, and each task looks the
numbers up in the plan (bounded by the capacity, not by the data), which gives sequence and offset.

The ids are those of a byte-level BPE of `tokenizers` (a JSON file). `tiktoken` reads the same vocabulary and is eight
times as fast, so it encodes all texts but those with a long run of white space, which its matcher can't take.

Defined cases: a null text is empty; an empty text is one separator; a text of any length is encoded whole; a null doc_id is
kept; a repeated row is packed as often as it comes; an empty table gives no rows. Extra columns are ignored, also
those with the names of results.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_rows, saved, table
from .token_counts import byte_symbols

CAPACITY = 2048
SEPARATOR = 0
#: Pieces that one numbering bucket of a length holds at most, on average.
BUCKET = 1_000_000
SPACES = re.compile(r"\s\s")
#: White space in a row from which the slower tokenizer encodes a text; the faster one fails at about a million.
LONG_BLANK = re.compile(r"\s{2000}")


class ByteBpe:
    """Ids of a byte-level BPE as little-endian 32-bit bytes.

    The vocabulary's splitting pattern ends with a look-ahead that only matters where white space stands in a row;
    texts without such a place are split by the plain pattern, which gives the same ids in half the time.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        self.marks = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        single = {bytes([b]) for b in range(256)}
        ranks = {bytes(byte[ord(c)] for c in piece): k for piece, k in model["vocab"].items() if all(ord(c) in byte for c in piece)}
        made = {bytes(byte[ord(c)] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]}
        ranks = {piece: k for piece, k in ranks.items() if piece in single or piece in made}
        plain = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
        self.full, self.plain = (
            tiktoken.Encoding("pieces", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, plain)
        )

    @functools.cached_property
    def whole(self):
        """The tokenizer itself; loaded only when a text needs it, as it is large."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids as bytes. A special token is one id wherever its string stands, as for the tokenizer itself."""
        if self.marks and self.marks.search(text):
            parts = self.marks.split(text)  # texts and special tokens in turn
            return b"".join(self.special[x].to_bytes(4, "little") if k % 2 else self.encode(x) for k, x in enumerate(parts) if x)
        if not SPACES.search(text):
            ids = self.plain.encode_ordinary(text)
        elif not LONG_BLANK.search(text):
            ids = self.full.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str | None) -> ByteBpe:
    return ByteBpe(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity or capacity
    return [(0, min(n, head))] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if kept) of every document."""

    def make():
        bpe = byte_bpe(path)
        end = SEPARATOR.to_bytes(4, "little")

        def row(doc_id, text):
            ids = bpe.encode(text or "") + end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                yield (doc_id, k, start, length, zlib.crc32(part), *([part] if keep_ids else []))

        return row

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_rows(docs, ["doc_id", "text"], make, schema)


class SumIndex:
    """The sums of one, two and three of the given lengths, up to capacity.

    pairs[s]: the larger parts a of the pairs (a, s - a), longest first. triples[s]: the largest parts a of triples (a, b, c)
    of which b and c stand in pairs[s - a], longest first.
    """

    def __init__(self, lengths: Iterable[int], capacity: int):
        self.there = np.zeros(capacity + 1, dtype=bool)
        self.there[[x for x in lengths if 0 < x <= capacity]] = True
        self.pairs: list[np.ndarray] = []
        least = np.full(capacity + 1, capacity + 1)  # the smallest larger part of a pair, for each sum
        for total in range(capacity + 1):
            a = np.arange(total - 1, (total + 1) // 2 - 1, -1) if total > 1 else np.zeros(0, dtype=np.int64)
            a = a[self.there[a] & self.there[total - a]]
            self.pairs.append(a)
            if len(a):
                least[total] = a[-1]
        self.triples: list[np.ndarray] = []
        for total in range(capacity + 1):
            a = np.arange(total - 2, -(-total // 3) - 1, -1) if total > 2 else np.zeros(0, dtype=np.int64)
            self.triples.append(a[self.there[a] & (least[total - a] <= a)])

    def fills(self, gap: int, left: np.ndarray, most: int = 3) -> Iterator[tuple[int, ...]]:
        """Combinations of at most `most` lengths that sum to the gap; fewer lengths first, then longer ones.

        left: counts that are left; they may fall between two combinations, and what has run out is passed over.
        """
        if most > 0 and left[gap]:
            yield (gap,)
        if most > 1:
            a = self.pairs[gap]
            for x in a[(left[a] > 0) & (left[gap - a] > 0)].tolist():
                yield x, gap - x
        if most > 2:
            a = self.triples[gap]
            for x in a[left[a] > 0].tolist():
                b = self.pairs[gap - x]
                for y in b[(b <= x) & (left[b] > 0) & (left[gap - x - b] > 0)].tolist():
                    if not left[x]:
                        break
                    yield x, y, gap - x - y


def fill_exactly(counts: dict[int, int], capacity: int, index: SumIndex, most: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences filled to the last token by a length and at most `most` others, and the counts that are left.

    A gap belongs to one length, and counts only fall, so each gap's combinations are walked once.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        for rest in index.fills(capacity - length, left, most) if length < capacity else [()]:
            if not left[length]:
                break
            pattern = (length, *rest)
            n = int(min(left[x] // pattern.count(x) for x in set(pattern)))
            if n:
                left[list(set(pattern))] -= np.array([n * pattern.count(x) for x in set(pattern)])
                plan.append((pattern, n))
    return plan, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences); every step uses up a length, so the plan is bounded by the capacity."""
    index = SumIndex(counts, capacity)
    plans = []
    for most in (3, 2, 1, 0):
        exact, left = fill_exactly(counts, capacity, index, most)
        plans.append(exact + best_fit(left, capacity))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: the longest pieces first, each into the smallest gap that takes it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if not n:
            return
        if not gap:
            done.append((pattern, n))
            return
        if gap not in open_:
            open_[gap] = []
            gaps.insert(bisect_left(gaps, gap), gap)
        open_[gap].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                add((length,) * each, n // each)
                add((length,) * (n % each), min(1, n % each))
                break
            gap = gaps[at]
            pattern, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            k = min(m, n)
            add(pattern, m - k)
            add((*pattern, length), k)
            n -= k
    return done + [x for group in open_.values() for x in group]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, base, offset): pieces first..last of a length go to sequence number - first + base."""
    out, used, base = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            used[length] = first + n
            out.append((length, first, first + n - 1, base, offset))
            offset += length
        base += n
    return out


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """A number from 0 within each length; a hot length is dealt to buckets that grow with the data."""
    buckets = max(256, total // BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["length", "bucket"]).withColumn("number", F.col("from") + F.col("rank")).drop("from", "rank", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; sequences are gapless from 0 and no longer than the capacity.

    pieces: doc_id, piece, length and ids_crc32, stored (it is read three times).
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = np.array(sorted(slots(plan_sequences(counts, capacity))), dtype=np.int64)
    # one ascending key for all lengths: where the numbers of a length begin in it, plus the number
    begins = np.zeros(capacity + 2, dtype=np.int64)
    for length, n in counts.items():
        begins[length + 1] = n
    begins = np.cumsum(begins)
    first = begins[plan[:, 0]] + plan[:, 1]
    ranked = numbered(pieces, sum(counts.values()))
    kept = [c for c in ranked.columns if c != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(first, begins[batch.column("length").to_numpy(zero_copy_only=False)] + number, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(row[:, 3] + number - row[:, 1]), pa.array(row[:, 4])], names=[*kept, "sequence_id", "offset"]
            )

    schema = StructType([*(ranked.schema[c] for c in kept), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenises once, stores the pieces, packs them. keep_ids adds each piece's token ids."""
    pieces = saved(token_pieces(docs, capacity, path, keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return pack(pieces, capacity).select(*columns)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
