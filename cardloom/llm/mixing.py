"""Mixing sources to target weights: exact quotas, split by chance among shards, filled with disjoint permuted blocks.

1. A source's documents are laid end to end, in an order that depends on their contents only, and cut into blocks of `block`
   words. Its target in words fixes how many blocks the mix takes, pass after pass through the source: whole passes first, the last
   one cut off at the target's word. So a source's words come out at its rounded target exactly, and a document is taken at
   most as often as there are passes.
2. The quotas of all sources are split among the output shards by a tree. A node gives its left child a share of its blocks that
   goes by the child's number of shards; how many of them come from each source is a draw without replacement from the node's
   blocks (multivariate hypergeometric, source by source, each a hypergeometric draw by inversion from its mode, in double
   precision, the chance being a hash of seed, node and source). Nothing is rounded: children add up to their node, the leaves
   to the quotas.
3. A shard's draws from a source are a range of numbers; the blocks with these numbers are found through a permutation of each
   pass's blocks (swap-or-not rounds, a bijection on any number of blocks), so shards' blocks are disjoint in a pass. A
   document computes its blocks' numbers and from them their shards by itself; a binary search in the source's starts does it.
4. Within a shard, blocks are ordered by a hash of their number (write_shards).

All of it is DataFrame functions. Documents are numbered by buckets of about BUCKET equal-hash documents, bucket starts being sums of
bucket sizes, so a source with a third of all rows is spread over many tasks; equal rows are counted before anything is
shuffled. Everything follows from contents and seed, so reruns agree, whatever the files' layout.

Defined cases: a null text has no words; documents without words are never taken; a null source is a source of its own, a null id an
id like others; rows that are equal in source, id and text are taken one by one, as copies; a source without words has target 0; more share
than all sources' caps allow gives every source its cap; an empty table gives no rows; a very long text is spread over its
blocks; extra columns are ignored, also those with the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Words of a block, blocks of a shard on average, and documents that are numbered together on average.
BLOCK, SHARD_BLOCKS, BUCKET = 256, 1 << 14, 10_000
#: Rounds of a permutation.
ROUNDS = 20
#: Shard starts (8 bytes each) of all sources that may be broadcast; beyond it documents and sources are joined by a shuffle.
BROADCAST_STARTS = 4_000_000
#: Levels of the tree that are planned together.
LEVELS = 6
SEED = 20240101
#: The query's weights, in turn, share of all sizes, and most passes through a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def units(docs: DataFrame) -> DataFrame:
    """source, doc_id, mark (of the text), size, copies: distinct documents and how often each stands there."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("source", "doc_id", F.xxhash64("text").alias("mark"), size.alias("size")).groupBy("source", "doc_id", "mark", "size").agg(F.count(F.lit(1)).alias("copies"))


def repeating_weights(counted: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, weight: the weights in turn, over the sources by code point, null last. One row for each source."""
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return counted.select("source").distinct().withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights)).cast("int")))


def source_targets(counted: DataFrame, weights: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, weight, source_size, target: share of all sizes by weight, no target above most times its source's size.

    What a capped source leaves is shared again by weight until none is above its cap; each round is one sum over the sources.
    A source without a weight gets none.
    """
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    joined = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
    sources = saved(joined.select("s.source", F.coalesce("w.weight", F.lit(0.0)).cast("double").alias("weight"), "source_size"), "sources")
    cap = most * F.col("source_size")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate, last = 0.0, None
    while rate != last:
        full = F.col("weight") * rate > cap
        capped, weight = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        last, rate = rate, (total - (capped or 0.0)) / weight if weight else rate
    # where every source is full, the last rate is one at which all of them were
    return sources.withColumn("target", F.least(cap, F.col("weight") * rate))


def log_factorial(n: Column) -> Column:
    """Of a double: Stirling's series eight places up, which is exact to double precision there, and back."""
    y = n + 8
    product = n + 1
    for k in range(2, 9):
        product = product * (n + k)
    return (y + 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, chance: Column) -> Column:
    """How many of `good` are among `draws` out of `total`, by inversion: values are tried from the mode outwards, up and down in turn.

    Longs; chance in [0, 1). Rounding can leave a rest of about 1e-12 of probability unassigned, which goes to the mode.
    """

    def inside(a: Column) -> Column:
        t, g, n, u = (a[x].cast("double") for x in "tgnu")
        low, high = F.greatest(F.lit(0.0), n - (t - g)), F.least(n, g)
        mode = F.greatest(low, F.least(high, F.floor((n + 1) * (g + 1) / (t + 2)).cast("double")))
        spread = F.sqrt(n * (g / t) * ((t - g) / t) * (t - n) / F.greatest(t - 1, F.lit(1.0)))

        def walk(b: Column) -> Column:
            low, high, mode = b["low"], b["high"], b["mode"]
            at_mode = F.exp(log_choose(g, mode) + log_choose(t - g, n - mode) - log_choose(t, n))
            none = F.lit(None).cast("double")
            start = let(at_mode, lambda p: F.struct(
                (u - p).alias("u"), F.when(u < p, mode).otherwise(none).alias("x"), mode.alias("up"), p.alias("up_p"), mode.alias("down"), p.alias("down_p")
            ))

            def step(s: Column, _: Column) -> Column:
                up, down = s["up"], s["down"]
                more = F.when(up < high, s["up_p"] * (g - up) * (n - up) / ((up + 1) * (t - g - n + up + 1))).otherwise(0.0)
                less = F.when(down > low, s["down_p"] * down * (t - g - n + down) / ((g - down + 1) * (n - down + 1))).otherwise(0.0)
                made = let(F.struct(more.alias("p"), less.alias("q")), lambda m: F.struct(
                    (s["u"] - m["p"] - m["q"]).alias("u"),
                    F.when(s["u"] < m["p"], up + 1).when(s["u"] < m["p"] + m["q"], down - 1).otherwise(none).alias("x"),
                    (up + 1).alias("up"), m["p"].alias("up_p"), (down - 1).alias("down"), m["q"].alias("down_p"),
                ))
                return F.when(s["x"].isNotNull(), s).otherwise(made)

            steps = F.least(high - low, 14 * b["spread"] + 32).cast("long")
            return F.coalesce(F.aggregate(F.sequence(F.lit(0).cast("long"), steps), start, step)["x"], mode)

        found = let(F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread")), walk)
        return F.when(low == high, low).otherwise(found).cast("long")

    return let(F.struct(total.alias("t"), good.alias("g"), draws.alias("n"), chance.alias("u")), inside)


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) that follows from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def drawn_quotas(quotas: Column, draws: Column, chance) -> Column:
    """Multivariate hypergeometric: how many of `draws` out of an array of quotas come from each; chance(place) gives a Column in [0, 1)."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(total.alias("total"), draws.cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def one(s: Column, i: Column) -> Column:
        q = F.get(quotas, i)
        x = hypergeometric(s["total"], q, s["draws"], chance(i))
        return let(x, lambda x: F.struct((s["total"] - q).alias("total"), (s["draws"] - x).alias("draws"), F.array_append(s["out"], x).alias("out")))

    places = F.sequence(F.lit(0), F.size(quotas) - 1)
    return F.when(F.size(quotas) > 0, F.aggregate(places, start, one)["out"]).otherwise(F.array().cast("array<bigint>"))


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard (from 0), quotas: one row with an array `quotas` of blocks, split among so many shards of (almost) equal size."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("width"), "quotas")
    width, level = shards, 0
    while width > 1:
        left = F.floor(F.col("width") / 2).cast("long")
        whole = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q)
        draws = F.floor(whole.cast("decimal(38,0)") * left / F.col("width")).cast("long")
        chance = lambda i: uniform(F.lit(seed), F.col("shard"), F.col("width"), i)
        split = nodes.withColumn("left", F.when(F.col("width") > 1, drawn_quotas(F.col("quotas"), draws, chance)))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        child = lambda shard, width, quotas: F.struct(shard.alias("shard"), width.alias("width"), quotas.alias("quotas"))
        both = F.array(child(F.col("shard"), left, F.col("left")), child(F.col("shard") + left, F.col("width") - left, rest))
        same = F.array(child(F.col("shard"), F.col("width"), F.col("quotas")))
        nodes = split.select(F.explode(F.when(F.col("width") > 1, both).otherwise(same)).alias("c")).select("c.*")
        width, level = -(-width // 2), level + 1
        # a row for each node, dealt out before the next level; a written table ends the plan now and then
        nodes = saved(nodes, "nodes") if level % LEVELS == 0 else nodes.repartition("shard") if level > 2 else nodes
    return nodes.select("shard", "quotas")


def permuted(place: Column, count: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. count - 1, chosen by key: in every round a place and its partner change places or don't, by a hash of the two."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), count) - x, count)
        return let(partner, lambda p: F.when(F.xxhash64(key, r, F.greatest(x, p)) % 2 == 0, p).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place, turn)


def placed(counted: DataFrame) -> DataFrame:
    """counted with first: the place of each unit's first word in its source's line."""
    buckets = max(1, -(-counted.count() // BUCKET))
    dealt = counted.withColumns({"_bucket": F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)), "_words": F.col("size") * F.col("copies")})
    before = lambda w: F.coalesce(F.sum("_words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("_words").alias("_words"))
    starts = sums.select("source", "_bucket", before(Window.partitionBy("source").orderBy("_bucket")).alias("_start"))
    within = dealt.withColumn("_before", before(Window.partitionBy("source", "_bucket").orderBy("doc_id", "mark", "size")))
    w, s = within.alias("w"), starts.alias("s")
    joined = w.join(s, F.col("w.source").eqNullSafe(F.col("s.source")) & (F.col("w._bucket") == F.col("s._bucket")))
    return joined.select("w.source", "w.doc_id", "w.mark", "w.size", "w.copies", (F.col("s._start") + F.col("w._before")).alias("first"))


def source_plans(targets: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, int]:
    """source, source_size, target, and how the source's blocks are drawn: key, full (whole blocks of a pass), blocks (of a pass), draws,
    rest (words of the last draw, 0 if whole), starts (first draw of each shard); and the number of shards."""
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    left = words - whole * F.col("source_size")
    blocks = F.ceil(F.col("source_size") / block)
    plans = targets.select(
        "source", "source_size", "target", F.xxhash64(F.lit(seed), "source").alias("key"), F.floor(F.col("source_size") / block).alias("full"),
        blocks.alias("blocks"), (whole * blocks + F.ceil(left / block)).alias("draws"), (left % block).alias("rest"),
    )
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    plans = saved(plans.withColumn("number", number), "plans")
    total = plans.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_blocks))
    root = plans.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "draws"))), lambda x: x["draws"]).alias("quotas"))
    each = shard_quotas(root, shards, seed).select("shard", F.posexplode("quotas").alias("number", "quota"))
    start = F.sum("quota").over(Window.partitionBy("number").orderBy("shard")) - F.col("quota")
    starts = each.withColumn("start", start).groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "start"))), lambda x: x["start"]).alias("starts"))
    return saved(plans.join(starts, "number"), "starts"), shards


def shard_of(draw: Column, starts: Column, shards: int) -> Column:
    """The last place in starts whose value is not above draw: binary search."""
    powers = F.array(*(F.lit(1 << k) for k in range(max(shards - 1, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(powers, F.lit(0), lambda at, p: at + F.when(F.get(starts, at + p) <= draw, p).otherwise(0))


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: source, doc_id, mark, copy, size, source_size, target, pieces.

    docs: source, doc_id, text. weights: source and weight, or weights that the sources by code point get in turn. pieces: what the mix takes
    of the document, as an array of shard, place (ordering the shard's blocks), word (of the source's line), start and words (of the document).
    """
    counted = saved(units(docs), "units")
    if not isinstance(weights, DataFrame):
        weights = repeating_weights(counted, weights)
    plans, shards = source_plans(source_targets(counted, weights, share, most), block, shard_blocks, seed)
    few = plans.count() * shards <= BROADCAST_STARTS
    each = placed(counted).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("first", F.col("first") + (F.col("copy") - 1) * F.col("size"))
    u, p = each.alias("u"), plans.drop("number").alias("p")
    joined = u.join(F.broadcast(p) if few else p, F.col("u.source").eqNullSafe(F.col("p.source")))

    first, size, full, key = F.col("first"), F.col("size"), F.col("full"), F.col("key")
    size_words = F.col("source_size")

    def piece(turn: Column, b: Column) -> Column:
        at = F.when(b < full, permuted(b, F.greatest(full, F.lit(1).cast("long")), F.xxhash64(key, turn))).otherwise(b)

        def taken(draw: Column) -> Column:
            end = F.when((draw == F.col("draws") - 1) & (F.col("rest") > 0), b * block + F.col("rest")).otherwise(F.least((b + 1) * block, size_words))
            low = F.greatest(first, b * block)
            words = F.when(draw < F.col("draws"), F.least(first + size, end) - low).otherwise(0)
            return F.struct(
                shard_of(draw, F.col("starts"), shards).cast("long").alias("shard"), F.xxhash64(key, draw).alias("place"), low.alias("word"), (low - first).alias("start"), words.cast("long").alias("words")
            )

        return let(turn * F.col("blocks") + at, taken)

    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / F.greatest(F.col("blocks"), F.lit(1).cast("long"))))
    own = F.sequence(F.floor(first / block), F.floor((first + size - 1) / block))
    every = F.flatten(F.transform(turns, lambda t: F.transform(own, lambda b: piece(t, b))))
    none = F.array().cast("array<struct<shard:bigint,place:bigint,word:bigint,start:bigint,words:bigint>>")
    pieces = F.when((size > 0) & (F.col("draws") > 0), F.filter(every, lambda x: x["words"] > 0)).otherwise(none)
    return joined.select("u.source", "doc_id", "mark", "copy", "size", "source_size", "target", pieces.alias("pieces"))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """shard, place, word, doc_id, start, words, text: the pieces of mix with their words, one blank between."""
    texts = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("mark")).dropDuplicates(["doc_id", "source", "mark"])
    pieces = mixed.select("source", "doc_id", "mark", F.explode("pieces").alias("p"))
    d, m = texts.alias("d"), pieces.alias("m")
    met = m.join(d, F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("m.source").eqNullSafe(F.col("d.source")) & (F.col("m.mark") == F.col("d.mark")))
    words = F.array_remove(F.split("d.text", r"[\x20\x09-\x0D]+"), "")
    cut = F.slice(words, (F.col("p.start") + 1).cast("int"), F.col("p.words").cast("int"))
    return met.select("p.shard", "p.place", "p.word", "m.doc_id", "p.start", "p.words", F.array_join(cut, " ").alias("text"))


def write_shards(texts: DataFrame, path: str) -> None:
    """Parquet, one folder for each shard; in it blocks stand in the order of their hashes, and words of a block in their source's order."""
    texts.repartition("shard").sortWithinPartitions("shard", "place", "word").write.partitionBy("shard").parquet(path)


def mix_report(mixed: DataFrame) -> DataFrame:
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return mixed.select("doc_id", "size", "source_size", "target", words.alias("taken"), F.size(F.array_distinct("pieces.shard")).cast("long").alias("n_shards"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(mix(table(spark, sf_dir, "documents")))
