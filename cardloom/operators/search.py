"""Text search over the catalog, and incremental catalog builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leading_int, match_score

#: Letters of a piece of a name.
PIECE = 3
#: Queries of one term that a task gives their cards to, about.
TOGETHER = 2048
CARD = ("card_id", "set_id", "local_id", "name", "hp", "set_total", "ord")


def number_hits(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id and cards whose number equals the query's; an equi join on the number."""
    return queries.select("query_id", "local_id").where("local_id <> ''").join(catalog.select(*CARD), "local_id")


def pieces(text: Column, size: int = PIECE) -> Column:
    """The distinct pieces of a text; a text shorter than a piece has none."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda k: F.substr(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows of texts with each distinct term that the text holds; no text meets a term with which it shares no piece.

    Terms shorter than a piece meet all texts, which is a cross join of those terms alone.
    """
    by_piece = texts.withColumn("_piece", F.explode(pieces(F.col(text))))
    often = by_piece.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    asked = terms.where(F.length(term) >= PIECE).withColumn("_piece", F.explode(pieces(F.col(term)))).join(often, "_piece", "left")
    rarest = asked.groupBy(term).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece"))["_piece"].alias("_piece"))
    long = by_piece.join(rarest, "_piece").where(F.contains(F.col(text), F.col(term))).drop("_piece")
    short = terms.where(F.length(term) < PIECE)
    return long.unionByName(texts.join(short, F.contains(F.col(text), F.col(term))))


def name_hits(queries: DataFrame, catalog: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    """query_id and the first cards, in catalog order, whose name holds the query's in any case.

    Names repeat over many cards, so distinct names meet distinct queries first: an equi join on one three-letter piece of each
    term, the one in the fewest names, then the check. Cards join by equal name after it, of each name the first `limit`. Terms repeat
    over many queries too, so each term's first cards are found once, and its queries get them as one row, in parts of about TOGETHER.
    """
    wanted = queries.where(F.length("name") >= least).select("query_id", F.lower(F.trim(F.col("name"))).alias("low"))
    asked = wanted.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    terms = asked.select("low")
    names = catalog.where("name is not null").select("name").distinct()
    pairs = holding(names.withColumn("_low", F.lower("name")), "_low", terms, "low").select("name", "low")
    of_name = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    cards = catalog.select(*CARD).withColumn("_k", of_name).where(F.col("_k") <= limit).drop("_k")
    of_term = F.row_number().over(Window.partitionBy("low").orderBy("ord"))
    first = pairs.join(cards, "name").withColumn("n", of_term).where(F.col("n") <= limit)
    listed = first.groupBy("low").agg(F.collect_list(F.struct(*CARD)).alias("cards"))
    copies = listed.join(asked, "low").select("low", "cards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = wanted.join(asked, "low").select("query_id", "low", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
    # the rows before the join are small and would be coalesced into few tasks, or broadcast; those after it are not
    spread = dealt.repartition(max(1, -(-wanted.count() // TOGETHER)), "low", "part").hint("merge")
    return spread.join(copies, ["low", "part"]).select("query_id", F.explode("cards").alias("c")).select("query_id", "c.*")


def exact_card(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cards by set and number: an equi join on the card id."""
    return queries.select("query_id", F.concat_ws("-", "set_id", "local_id").alias("card_id")).join(catalog.drop("query_id"), "card_id")


def search_cards(queries: DataFrame, catalog: DataFrame, limit: int = 50) -> DataFrame:
    """query_id, card_id, match_score, position: number and name hits, deduplicated, scored and ranked.

    queries: query_id, name, local_id, total (text), hp. Equal scores go by the card's number, larger first, then by
    order of appearance (number hits before name hits, each in catalog order).
    """
    hits = number_hits(queries, catalog).select("query_id", *CARD, F.lit(0).alias("source")).unionByName(name_hits(queries, catalog).withColumn("source", F.lit(1)))
    once = F.row_number().over(Window.partitionBy("query_id", "card_id").orderBy("source", "ord"))
    unique = hits.repartition("query_id").withColumn("n", once).where("n = 1").drop("n")
    q = queries.select("query_id", F.col("name").alias("q_name"), F.col("local_id").alias("q_local"), F.col("total").alias("q_total"), F.col("hp").alias("q_hp"))
    scored = unique.join(q, "query_id").withColumn(
        "match_score", match_score(F.col("q_name"), F.col("q_local"), F.col("q_total"), F.col("q_hp"), F.col("name"), F.col("local_id"), F.col("set_total"), F.col("hp"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), F.desc(F.coalesce(leading_int(F.col("local_id")), F.lit(0))), "source", "ord")
    return scored.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= limit).select("query_id", "card_id", "match_score", "position")


def new_cards(listing: DataFrame, existing: DataFrame, key: str = "card_id") -> DataFrame:
    """Listed cards that are not in the catalog yet; also what is left of an interrupted build."""
    return listing.join(existing.select(key), key, "left_anti")


def merge_catalog(existing: DataFrame, added: DataFrame, key: str = "card_id") -> DataFrame:
    """The catalog with the added cards; a card that is in both stays as it is."""
    return existing.unionByName(new_cards(added, existing, key))


def first_wins(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def build_report(statuses: DataFrame) -> DataFrame:
    """How many cards each build status has, and the first errors by name. statuses: card_id, status, error."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("cards"), F.min("error").alias("first_error"))
