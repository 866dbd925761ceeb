"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Text and items are lower-cased (A-Z) and reduced to words of digits, letters and anything beyond ASCII. The
patterns are the windows of 13 consecutive item words (an item with fewer words is one window); a document's
words are scanned once, and every match is mapped back to places in the original text.

The automaton reads the numbers of the items' words, each written with a few symbols (any other word has a symbol of
its own), so its size does not depend on how long words are. A benchmark of more than MAX_PATTERN_BYTES is dealt to several automata, each scans all
documents, and the hits are united by document.

The items are sent to every executor once, and a Python worker builds an automaton once for all its tasks.

Defined cases: null and empty texts have no words; a very long text is scanned whole, in time linear in it; items without words
never match; repeated items count by distinct item_id; a null item_id is not counted but its words are hit; repeated document rows
give one row each; an empty table gives no rows, an empty benchmark no hits; extra columns are ignored by the scan, also those with
the names of results, and kept by the filter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, by_ids, fresh, map_rows, table

WINDOW = 13
#: Share of hit words from which a document counts as contaminated: 1 of 20.
SHARE = 20
#: Bytes of all items' texts for one automaton: about 250 bytes of memory in each Python worker for one of text.
MAX_PATTERN_BYTES = 2_000_000
#: Symbols for one digit of a word's number; a node's edges are searched one after another, so it is small.
DIGITS = 32

#: Lower-cases A-Z, keeps digits, a-z and all bytes of characters beyond ASCII, blanks the rest.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[int], size: int = WINDOW) -> Iterator[tuple[int, ...]]:
    if words:
        for k in range(max(1, len(words) - size + 1)):
            yield tuple(words[k : k + size])


class Patterns:
    """The items' windows as one Aho-Corasick automaton over word numbers."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        import ahocorasick

        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[int]] = {}
        self.items = list(dict.fromkeys(item for item, _ in items))
        place = {item: k for k, item in enumerate(self.items)}
        for item, text in sorted(items, key=lambda x: place[x[0]]):  # rows of one item together, so that its last window names it
            words = [numbers.setdefault(w, len(numbers)) for w in normal_words(text)]
            for w in windows(words, size):
                owners = found.setdefault(w, [])
                if not owners or owners[-1] != place[item]:
                    owners.append(place[item])
        self.owners = list(found.values())
        # every digit's place has symbols of its own, so a match can only start where a word starts
        self.width = next(k for k in range(1, 9) if DIGITS**k >= len(numbers))
        codes = ["".join(chr(DIGITS * p + n // DIGITS**p % DIGITS) for p in range(self.width)) for n in range(len(numbers))]
        self.codes = dict(zip(numbers, codes, strict=True))
        self.other = chr(DIGITS * self.width) * self.width
        self.tree = ahocorasick.Automaton() if found else None
        for k, w in enumerate(found):
            self.tree.add_word("".join(map(codes.__getitem__, w)), (len(w), k))
        if found:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        hit = np.zeros(len(words), dtype=bool)
        found: set[int] = set()
        if self.tree is not None and words:
            get, other = self.codes.get, self.other
            for end, (n, window) in self.tree.iter("".join([get(w, other) for w in words])):
                last = end // self.width
                hit[last - n + 1 : last + 1] = True
                found.add(window)
        return hit, {self.items[k] for k in set().union(*(self.owners[w] for w in found))}


#: The automaton that this Python worker built last, by the name of its items.
_built: dict[str, Patterns] = {}


class SharedPatterns:
    """Items on every executor, and the automaton made of them when a worker first asks for it."""

    def __init__(self, spark: SparkSession, items: list[tuple[object, str | None]], size: int):
        self.name, self.size = uuid.uuid4().hex, size
        self.items = spark.sparkContext.broadcast(items)  # at most MAX_PATTERN_BYTES of text

    def get(self) -> Patterns:
        if self.name not in _built:
            _built.clear()
            _built[self.name] = Patterns(self.items.value, self.size)
        return _built[self.name]


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as places in the original text (code points, end exclusive)."""
    import re

    spans: list[list[int]] = []
    last = -2
    for k, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
        if hit[k]:
            if last == k - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = k
    return [tuple(s) for s in spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted, as strings), spans (start, end in the original text)."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    bytes_ = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(bytes_) // limit))
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    if blocks == 1:
        return map_rows(docs, ["doc_id", "text"], _scanner(SharedPatterns(docs.sparkSession, [tuple(r) for r in named.collect()], size)), schema)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").groupBy("row", "doc_id").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    found = None
    for b in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        hits = map_rows(keyed, ["row", "doc_id", "text", "copies"], _word_scanner(SharedPatterns(docs.sparkSession, [tuple(r) for r in part.collect()], size)),
                        "row long, doc_id long, copies long, n_words long, hit array<int>, items array<string>, text string")
        found = hits if found is None else found.unionByName(hits)
    united = found.groupBy("row", "doc_id").agg(
        F.first("copies").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("text").alias("text"),
    )
    return map_rows(united, ["doc_id", "copies", "n_words", "hit", "items", "text"], _united, schema)


def _scanner(shared: SharedPatterns):
    def make():
        patterns = shared.get()

        def row(doc_id, text):
            words = normal_words(text)
            hit, found = patterns.scan(words)
            spans = [{"start": a, "end": b} for a, b in original_spans(text, hit)] if found else []
            yield doc_id, len(words), int(hit.sum()), sorted(x for x in found if x is not None), spans

        return row

    return make


def _word_scanner(shared: SharedPatterns):
    def make():
        patterns = shared.get()

        def row(row_id, doc_id, text, copies):
            words = normal_words(text)
            hit, found = patterns.scan(words)
            yield row_id, doc_id, copies, len(words), np.flatnonzero(hit).tolist(), sorted(x for x in found if x is not None), text if found else None

        return row

    return make


def _united():
    def row(doc_id, copies, n_words, places, items, text):
        hit = np.zeros(n_words, dtype=bool)
        hit[places] = True
        spans = [{"start": a, "end": b} for a, b in original_spans(text, hit)] if places else []
        for _ in range(copies):
            yield doc_id, n_words, int(hit.sum()), items, spans

    return row


def contamination_report(found: DataFrame, share: int = SHARE) -> DataFrame:
    """The digest columns of find_contamination's rows."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one scan without a join.

    Nulls and empty texts are clean; repeated rows are judged alike; an empty table stays empty. Beyond limit bytes of benchmark text, rows are removed by a key of id and text, so each row is judged by itself there too.
    """
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    bytes_ = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if int(bytes_) > limit:
        row = F.xxhash64("doc_id", "text")  # never null
        keyed = docs.select(row.alias("doc_id"), "text")
        name = fresh(docs, "_row")
        bad = contamination_report(find_contamination(keyed, benchmark, size, limit), share).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
        return by_ids(docs.withColumn(name, row), bad, name, "left_anti").select(*docs.columns)
    shared = SharedPatterns(docs.sparkSession, [tuple(r) for r in named.collect()], size)

    def run(batches):
        patterns = shared.get()
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                words = normal_words(text)
                hit = int(patterns.scan(words)[0].sum())
                keep.append(not (hit and share * hit >= len(words)))
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return arrow_ready(docs).mapInArrow(run, docs.schema)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
