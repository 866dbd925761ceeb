"""Phrase collocation mining with stripes: phrases of two to five words that occur together more than their parts explain.

A stripe is what is known of one prefix of one language: a counter from each word that follows it to how often, and under no
word how often it is followed by anything else or by nothing. Tasks add up the stripes of their texts and send a stripe as
one row; stripes of one prefix are merged elementwise. One structure then holds everything:

* an entry (prefix, word) is the count of the phrase they make,
* a prefix's total is the count of the prefix itself, so of every part that a phrase is cut into,
* a prefix's largest entry, and the largest entry among those that end in a phrase, say whether a phrase always stands in a
  longer one (with one word more, on the right or on the left; a still longer one is no more frequent).

A phrase of at least `least` occurrences has only parts that are as frequent, so there are four passes: words; stripes of single
words, for words that may be frequent; stripes of pairs that may be frequent; stripes of three and four words, along triples that may be
frequent. "May be" is a bitmap of hashes of the frequent phrases of the pass before: it is of bounded size whatever the data, and it
may let others through, which costs work but no exactness, since what decides are the merged counts.

The merge is a Spark aggregation, which spills. Stripes of a prefix that starts with a common phrase (one of a HOT-th of its language's words or
more, so at most HOT of them) are cut into PARTS by hashes of the next words, so that no task gets all of them. Tasks' own counters
are cut at CHUNK words.

Defined cases: null texts are empty, a null language is `und`, together with documents that say so; repeated rows count each time;
ties go by the contract's order; a very long text is read whole; an empty table gives no rows; extra columns are ignored, also
those with the names of results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_ready, saved, spark_schema, table

#: Least occurrences of a phrase, its most words, and the percentage of its occurrences within a longer one that drops it.
LEAST, LONGEST, INSIDE = 100, 5, 100
#: Phrases that are returned of each language.
TOP = 2000
#: Words of one language that a task counts at once, and distinct words that it remembers.
CHUNK, MEMO = 1_000_000, 400_000
#: A phrase with this part of its language's words, and the number of parts that stripes of prefixes starting with it are cut into.
HOT, PARTS = 1000, 32
#: Least number of buckets that a language's prefixes are dealt to, and frequent phrases for each bucket beyond that.
LEAST_BUCKETS, BUCKET_PHRASES = 256, 256
#: Bits of a bitmap for each of its entries, and the most bits of one (32 MB).
BITS_EACH, MOST_BITS = 64, 1 << 28

BREAK = b"."
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_OTHER = np.int64(0xFFFFFFFF)
_LOW = 0xFFFFFFFF
_MUL = (1_540_483_477, 668_265_261)  # below 2**31, so that products with 32-bit hashes are the same in both languages


def words_of(texts: list[str | None]) -> list[bytes]:
    """All words of texts, with BREAK between pieces and between texts."""
    joined = BREAK.join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    return joined.translate(_FOLD).replace(BREAK, b" . ").split()


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    langs = np.array(batch.column("lang").to_pylist(), dtype=object)
    texts = batch.column("text").to_pylist()
    for lang in sorted(set(langs.tolist())):
        yield lang, [texts[k] for k in np.flatnonzero(langs == lang)]


def spoken(docs: DataFrame) -> DataFrame:
    return arrow_ready(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, count of all words."""
    schema = "lang string, word string, count bigint"
    fields = spark_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                counter.pop(BREAK, None)
                words = pa.array([w.decode("utf-8", "surrogatepass") for w in counter], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counter.values(), pa.int64())], schema=fields)
            held.clear()

        for batch in batches:
            for lang, texts in by_lang(batch):
                held.setdefault(lang, Counter()).update(words_of(texts))
            if sum(map(len, held.values())) > MEMO:
                yield from flush()
        yield from flush()

    return spoken(docs).mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("count").alias("count"))


def word_hash(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), word))


def phrase_hash(hashes: list):
    """Of the hashes of a phrase's words; Columns or arrays of int64. A single word's is its own."""
    made = hashes[0]
    for following in hashes[1:]:
        if isinstance(made, Column):
            made = F.shiftright((made * _MUL[0]).bitwiseXOR(following * _MUL[1]), 13).bitwiseAND(F.lit(_LOW))
        else:
            made = ((made * _MUL[0]) ^ (following * _MUL[1])) >> 13 & _LOW
    return made


class Bitmap:
    """A set of hashes that may hold more than was put in, never less."""

    def __init__(self, bits: int, places: np.ndarray, values: np.ndarray):
        self.mask = np.int64(bits - 1)
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[places] = values.view(np.uint64)
        self.bytes = self.words.astype("<u8").tobytes()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def has_one(self, hash_: int) -> bool:
        at = hash_ & (len(self.bytes) * 8 - 1)
        return bool(self.bytes[at >> 3] >> (at & 7) & 1)


def bitmap(hashes: DataFrame, count: int) -> Broadcast:
    """hashes: one column `hash` of non-negative longs, about count of them. At most MOST_BITS are collected and sent."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * max(count, 1) - 1).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(at, 6).alias("place"), F.expr(f"shiftleft(1L, cast(hash & {bits - 1} & 63 as int))").alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    return hashes.sparkSession.sparkContext.broadcast(Bitmap(bits, words.column("place").to_numpy(), words.column("bits").to_numpy()))


class Vocabulary(dict):
    """Numbers of a language's words that may be frequent, from 0; -1 of other words and of breaks."""

    def __init__(self, lang: str, frequent: Bitmap):
        super().__init__({BREAK: -1})
        self.start, self.has = zlib.crc32(lang.encode() + b"\0"), frequent.has_one
        self.words: list[str] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        hash_ = zlib.crc32(word, self.start)
        number = -1
        if self.has(hash_):
            number = len(self.words)
            self.words.append(word.decode("utf-8", "surrogatepass"))
            self.hashes.append(hash_)
        self[word] = number
        return number


def counted(ids: np.ndarray, good: np.ndarray, orders: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (words of a prefix) the distinct (prefix, next word) of ids: prefix numbers in ascending order, a place of each, next
    words (_OTHER for none), counts. good[i]: the words from i on, as many as the first order says, may be a frequent phrase."""
    at = np.flatnonzero(good)
    names = ids[at].astype(np.int64)
    for k in range(1, orders.start):
        names = np.unique(names << 32 | ids[at + k], return_inverse=True)[1]
    for order in orders:
        if not len(at):
            return
        on = good[at + order - orders.start + 1]
        following = np.where(on, ids[np.minimum(at + order, len(ids) - 1)], _OTHER).astype(np.int64)
        keys = names << 32 | following
        distinct, counts = np.unique(keys, return_counts=True)
        place = np.zeros(names.max() + 1, dtype=np.int64)
        place[names] = at
        yield order, distinct >> 32, place[distinct >> 32], distinct & _OTHER, counts
        at = at[on]
        names = np.unique(keys[on], return_inverse=True)[1]


def stripe_rows(ids: np.ndarray, known: Vocabulary, good: np.ndarray, hot: np.ndarray, orders: range, buckets: int, lang: str, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The stripes of ids, a row for each bucket of prefixes: the entries of its stripes, each as the phrase of prefix and next word, and their counts."""
    words = pa.array([*known.words, ""], pa.string())  # no next word is an empty one
    hashes = np.array(known.hashes, dtype=np.int64)
    part_of = np.append(hashes // 7 % PARTS, 0)
    for order, _, place, following, counts in counted(ids, good, orders):
        word = np.where(following == _OTHER, len(words) - 1, following)
        own = [ids[place + k] for k in range(order)]
        bucket = (phrase_hash([hashes[w] for w in own]) + 7919 * np.where(hot[place], part_of[word], 0)) % buckets
        by = np.argsort(bucket, kind="stable")
        phrases = pc.binary_join_element_wise(*(words.take(pa.array(w[by])) for w in (*own, word)), " ")
        bucket = bucket[by]
        new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        offsets = pa.array(np.append(new, len(bucket)).astype(np.int32))
        columns = [pa.array([lang] * len(new), pa.string()), pa.array(bucket[new].astype(np.int32)), pa.ListArray.from_arrays(offsets, phrases), pa.ListArray.from_arrays(offsets, pa.array(counts[by].astype(np.int32)))]
        whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
        for k in range(0, whole.num_rows, 256):
            yield whole.slice(k, 256)


def stripes(docs: DataFrame, orders: range, words: Broadcast, phrases: Broadcast | None, hot: dict[str, set[int]], buckets: int, least: int = LEAST) -> DataFrame:
    """lang, prefix, total, extensions (array of next, count; from `least` on) of prefixes of so many words.

    words, phrases: bitmaps of the frequent words, and of the frequent phrases of as many words as the first order; hot: hashes of each
    language's hot ones. Tasks send the stripes of a bucket of prefixes together. A hot prefix is in up to PARTS buckets and has a row of
    each: its total is the sum of theirs, its extensions are the union.
    """
    schema = "lang string, bucket int, phrases array<string>, counts array<int>"
    fields = spark_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            ids, own = np.concatenate(waiting.pop(lang)), known[lang]
            ok = ids >= 0
            at = np.flatnonzero(ok[: len(ids) - orders.start + 1])
            for k in range(1, orders.start):
                at = at[ok[at + k]]
            hashes = np.array(own.hashes, dtype=np.int64)
            made = phrase_hash([hashes[ids[at + k]] for k in range(orders.start)])
            if phrases is not None:
                keep = phrases.value.has(made)
                at, made = at[keep], made[keep]
            good, common = np.zeros(len(ids) + 1, dtype=bool), np.zeros(len(ids), dtype=bool)
            good[at] = True
            common[at] = np.isin(made, list(hot.get(lang, ())))
            yield from stripe_rows(ids, own, good, common, orders, buckets, lang, fields)

        for batch in batches:
            for lang, texts in by_lang(batch):
                if lang not in known:
                    known[lang] = Vocabulary(lang, words.value)
                found = [*words_of(texts), BREAK]
                waiting.setdefault(lang, []).append(np.fromiter(map(known[lang].__getitem__, found), np.int32, len(found)))
                if sum(map(len, waiting[lang])) > CHUNK:
                    yield from flush(lang)
            if sum(map(len, known.values())) > MEMO:
                for lang in list(waiting):
                    yield from flush(lang)
                known.clear()
        for lang in list(waiting):
            yield from flush(lang)

    sent = spoken(docs).mapInArrow(run, schema).repartition("lang", "bucket")
    # elementwise, where the stripes of a prefix have met: these aggregations need no exchange of their own
    each = sent.select("lang", "bucket", F.explode(F.arrays_zip("phrases", "counts")).alias("e")).select("lang", "bucket", F.col("e.phrases").alias("phrase"), F.col("e.counts").cast("long").alias("count"))
    following = F.substring_index("phrase", " ", -1)
    prefix = F.expr("left(phrase, length(phrase) - length(next) - 1)")
    merged = each.groupBy("lang", "bucket", "phrase").agg(F.sum("count").alias("count")).withColumn("next", following).withColumn("prefix", prefix)
    entry = F.when((F.col("next") != "") & (F.col("count") >= least), F.struct("next", "count"))
    return merged.groupBy("lang", "bucket", "prefix").agg(F.sum("count").alias("total"), F.collect_list(entry).alias("extensions")).drop("bucket")


def frequent_bitmap(found: DataFrame) -> tuple[Broadcast, int]:
    """The bitmap of found's hashes, and how many buckets their stripes are dealt to."""
    count = found.count()
    return bitmap(found.select("hash"), count), max(LEAST_BUCKETS, -(-count // BUCKET_PHRASES))


def hot_hashes(found: DataFrame, sizes: DataFrame) -> dict[str, set[int]]:
    """Hashes of the phrases (lang, hash, count) with a HOT-th of their language's words or more: HOT of each language at most."""
    met = found.join(sizes, "lang").where(F.col("count") * HOT >= F.col("n")).select("lang", "hash").collect()
    out: dict[str, set[int]] = {}
    for lang, hash_ in met:
        out.setdefault(lang, set()).add(hash_)
    return out


def mine_stripes(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All stripes of prefixes of one to longest - 1 words, and lang, n (word occurrences)."""
    counts = saved(word_counts(docs), "words")
    sizes = counts.groupBy("lang").agg(F.sum("count").alias("n"))
    found = counts.where(F.col("count") >= least).select("lang", word_hash(F.col("lang"), F.col("word")).alias("hash"), "count")
    words, buckets = frequent_bitmap(found)
    phrases, every, order = None, None, 1
    while order < longest:
        # triples are rare enough to go on along them to the end
        orders = range(order, order + 1 if order < 3 else longest)
        made = saved(stripes(docs, orders, words, phrases, hot_hashes(found, sizes), buckets, least), "stripes")
        every = made if every is None else every.unionByName(made)
        order = orders.stop
        if order < longest:
            entry = made.select("lang", F.explode("extensions").alias("e"), F.split("prefix", " ").alias("p"))
            hashes = [word_hash(F.col("lang"), F.get("p", F.lit(k))) for k in range(orders.start)] + [word_hash(F.col("lang"), F.col("e.next"))]
            found = entry.select("lang", phrase_hash(hashes).alias("hash"), F.col("e.count").alias("count"))
            phrases, buckets = frequent_bitmap(found)
    return every, sizes


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two to longest words that stands in no longer one most of the time.

    a: occurrences; l, r: those of the two parts of the cut with the lowest score; n: of all words of the language.
    """
    every, sizes = mine_stripes(docs, least, longest)
    largest = F.array_max(F.transform("extensions", lambda e: e["count"]))
    prefixes = every.groupBy("lang", "prefix").agg(F.sum("total").alias("f"), F.max(largest).alias("right")).where(F.col("f") >= least)
    entries = every.select("lang", F.explode("extensions").alias("e"), "prefix").select("lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.count").alias("a"))
    tails = entries.groupBy("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")).agg(F.max("a").alias("left"))
    rights = prefixes.select("lang", F.col("prefix").alias("phrase"), "right")
    longer = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    alone = entries.join(tails, ["lang", "phrase"], "left").join(rights, ["lang", "phrase"], "left").where(100 * longer < inside * F.col("a")).select("lang", "phrase", "a")

    words = F.split("phrase", " ")
    cuts = alone.select("lang", "phrase", "a", F.posexplode(F.expr("slice(split(phrase, ' '), 2, size(split(phrase, ' ')) - 1)")).alias("k", "_")).select(
        "lang", "phrase", "a", (F.col("k") + 1).alias("k"),
        F.array_join(F.slice(words, F.lit(1), F.col("k") + 1), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 2, F.size(words)), " ").alias("tail"),
    )
    part = lambda name, count: prefixes.select("lang", F.col("prefix").alias(name), F.col("f").alias(count))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(sizes, "lang").withColumns({c: exact(c) for c in "alrn"})
    score = F.expr("(cast(1000 as decimal(4,0)) * a * n) div (l * r)")
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    long = lambda c: F.col(c).cast("long")
    return lowest.select("lang", "phrase", long("a").alias("a"), long("m.l").alias("l"), long("m.r").alias("r"), long("n").alias("n"), F.col("m.score").alias("score"))


def best_of(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first phrases with their rank from 1; shares of a language are cut down first, so none is sorted whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    fewer = phrases.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_n", some).where(F.col("_n") <= top)
    return fewer.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(collocations(table(spark, sf_dir, "documents")))


def collocations_sql(least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP) -> str:
    """What DuckDB should say, in its own way: every phrase is counted, and looked for in every longer one."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM listed GROUP BY lang),
placed AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM listed, range(1, {longest + 1}) t(m) WHERE len(w) >= m),
often AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= {least}),
alone AS (
  SELECT * FROM often o WHERE m > 1 AND NOT EXISTS (
    SELECT 1 FROM often x WHERE x.lang = o.lang AND x.m > o.m AND 100 * x.f >= {inside} * o.f AND contains(' ' || x.phrase || ' ', ' ' || o.phrase || ' '))),
cut AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM alone),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n, (1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cut c JOIN sizes USING (lang) JOIN often h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
    JOIN often t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= {top}
"""


OP12_SQL = collocations_sql()
