"""Periodic run detection: stretches of words that repeat themselves at least four times in a row.

A run is a maximal stretch of words in which words `period` apart are identical, period being the smallest such number, that
is at least MIN_WORDS and REPEATS periods long. Runs are found with a dictionary of basic factors, built for all texts of an
Arrow batch at once: on level k every stretch of L = 2**k words that occurs twice in its text has a name, made from the names
of its two halves. Each occurrence is compared with its successor (the next occurrence of the same name) where both lie
within 2 * L words, so where they are d <= L apart. Such occurrences form arithmetic progressions of difference d, and
neighbouring places with one d belong to progressions of one stretch of period d, so each group of neighbours proposes a
period and, with L + d words added, the whole stretch:

* a run of period q is proposed on every level with q <= L that it is long enough for, the first being below 2 * q, where
  REPEATS * q >= q + L leaves at least one place; so none is missed;
* the group can't be extended: a word more on either side that keeps the period would make one more place with the same d;
* d is the smallest period: a smaller one would divide d and put the successor nearer.

Proposals of one run on several levels are merged. Only places whose name repeats in their text go on to the next level, so
work and memory fall off quickly in ordinary prose, and are n log n where everything repeats.

The operator maps rows: nothing is shuffled, and a text of any length is one task's work, as a whole.

Defined cases: a null text has no words and no runs, and collapses to null; an empty text has no words; repeated rows and ties are
judged each by itself; a row without an id is judged like any other; an empty table stays empty; extra columns are kept by
collapse_runs and ignored by find_runs, also those with the names of results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, spark_schema, table

#: Fewest words, and fewest periods, of a run.
MIN_WORDS, REPEATS = 6, 4
#: What separates words.
BLANK = r"[\x20\x09-\x0D]+"

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers, equal only for equal words of one text, and the place where each text starts (and the end)."""
    ends = np.cumsum([0, *map(len, texts)])
    codes = np.empty(ends[-1], dtype=np.int64)
    used = 0
    for words, at in zip(texts, ends.tolist(), strict=False):
        seen: dict[bytes, int] = {}
        codes[at : at + len(words)] = [used + seen.setdefault(w, len(seen)) for w in words]
        used += len(seen)
    return codes, ends


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys that occur more than once, in the order of (key, place), and the number of each one's key."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    same = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = np.concatenate([[True], ~same])[twice] if len(keys) else twice
    return order[twice], np.cumsum(first) - 1


def runs_of(codes: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. Equal codes may stand in one text only."""
    found = []
    at = np.arange(len(codes))  # places whose factor of this level may repeat
    keys, level = codes, 1
    names = np.full(len(codes), -1, dtype=np.int64)
    while len(at) > 1:
        order, number = named(keys)
        at_sorted = at[order]
        if not len(at_sorted):
            break
        # successor distances, at places in ascending order
        gap = np.zeros(len(at_sorted), dtype=np.int64)
        gap[:-1] = np.where(number[1:] == number[:-1], at_sorted[1:] - at_sorted[:-1], 0)
        names[:] = -1
        names[at_sorted] = number
        near = (gap > 0) & (gap <= level)
        place, d = at_sorted[near], gap[near]
        by_place = np.argsort(place)
        place, d = place[by_place], d[by_place]
        if len(place):
            new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (d[1:] != d[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(place)]]) - 1
            start, period = place[first], d[first]
            length = place[last] - start + period + level
            long = length >= np.maximum(min_words, repeats * period)
            found.append(np.column_stack([start[long], length[long], period[long]]))
        # a factor of twice the length repeats only where both halves do
        at = np.sort(at_sorted)
        at = at[at + level < len(codes)]
        second = names[at + level]
        at, second = at[second >= 0], second[second >= 0]
        keys = names[at] * len(codes) + second
        level *= 2
    if not found:
        return np.empty((0, 3), dtype=np.int64)
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def batch_runs(texts: list[str | None], min_words: int, repeats: int) -> Iterator[tuple[list[bytes] | None, np.ndarray]]:
    """Each text's words (None for null) and its runs; bytes.split() takes blanks, tabs and line ends, and nothing else, as separators."""
    words = [[] if t is None else t.encode("utf-8", "surrogatepass").split() for t in texts]
    codes, ends = word_codes(words)
    runs = runs_of(codes, min_words, repeats)
    cuts = np.searchsorted(runs[:, 0], ends)
    for k, text in enumerate(texts):
        own = runs[cuts[k] : cuts[k + 1]] - [ends[k], 0, 0]
        yield None if text is None else words[k], own


def _run_lists(runs: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*runs, np.empty((0, 3), dtype=np.int64)])
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], names=["start", "length", "period"]))


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start), collapsed (the kept words, one blank between)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {_RUNS}, collapsed string"
    fields = spark_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for words, runs in batch_runs(batch.column("text").to_pylist(), min_words, repeats):
                sizes.append(len(words or []))
                found.append(runs)
                texts.append(None if words is None else _collapsed(words, runs))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), _run_lists(found), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return arrow_ready(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs):
        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """docs with the text of every document that has a run replaced by its kept words; other texts stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, (words, runs) in enumerate(batch_runs(texts, min_words, repeats)):
                if len(runs):
                    texts[k] = _collapsed(words, runs)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_ready(docs).mapInArrow(run, docs.schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by a hash of their ids) repeat themselves from some word on."""
    hash_ = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(hash_ / 10).cast("long")
    words = F.array_remove(F.split("text", BLANK), "")

    def looped(w: Column, n: Column) -> Column:
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    repeats = F.coalesce(hash_ % 10 == 0, F.lit(False))
    split = docs.select("doc_id", "text", F.when(repeats, words).alias("_words"))
    n = F.size("_words")
    return split.select("doc_id", F.when(n > 0, looped(F.col("_words"), n)).otherwise(F.col("text")).alias("text"))


def runs_report(found: DataFrame) -> DataFrame:
    """The digest columns of find_runs' rows."""
    longest = F.get(F.array_sort("runs", lambda x, y: F.coalesce(*(F.nullif(F.signum(d), F.lit(0.0)) for d in (y.length - x.length, x.start - y.start, x.period - y.period)), F.lit(0.0)).cast("int")), F.lit(0))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    every = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_longest.start", "_longest.length", "_longest.period",
        F.floor(1000 * F.col("_longest.length") / F.col("_longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(every, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.coalesce("collapsed", F.lit("")), "utf-8"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(find_runs(planted(table(spark, sf_dir, "documents"))))
