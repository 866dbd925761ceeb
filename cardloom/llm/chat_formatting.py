"""Chat formatting: a dialogue rendered once from every participant's perspective, with DataFrame functions only.

For each participant (a role that speaks) the whole dialogue is rendered with that speaker as the assistant and everyone else as
a user named after the role. A message becomes
    <|im_start|>assistant\\n{text}<|im_end|>\\n   or   <|im_start|>user name={role}\\n{text}<|im_end|>\\n
and is trained on (mask) in the assistant's text and end mark only. System messages stay system messages in every rendering and
are no participant. A control mark that somebody writes is broken up (`<|` becomes `< |`), so no text can open or end a turn; so is one in
a role's name, where line ends become blanks too. Rows are one message of one perspective, with its place in the rendering, so a conversation of
any length is never held in one row; assembled() joins them for conversations of ordinary length.

Places are prefix sums in two steps: within chunks of CHUNK turn numbers, then over the chunks, so that one
conversation with a third of all rows is spread over many tasks.

Defined cases: a null text is empty; a null role is the speaker `unknown`; messages with equal turns are ordered by
role, then text; messages with a null turn come first; repeated rows are repeated messages; a null conv_id is a
conversation of its own; a conversation with system messages only gives no rows; an empty table gives no rows; a very long text
stays whole; messages without a turn, or with equal turns, of one conversation are ordered in one task; extra columns are ignored,
also those with the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 64


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def spoken_name() -> Column:
    return F.translate(unmarked(F.col("speaker")), "\n\r", "  ")


def rotate(conversations: DataFrame) -> DataFrame:
    """One row for each message in each perspective: rendered text, its place, and the trained part's place.

    conv_id, perspective, position (of the message, from 0), turn, speaker, rendered, start, end (of the rendered
    message in the rendering), mask_start, mask_end (of its trained part; equal if none), trained.
    """
    said = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), unmarked(F.coalesce("text", F.lit(""))).alias("text")
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 40))))
    speakers = said.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()

    heads = F.when(F.col("speaker") == "system", F.lit(f"{START}system\n")).when(
        F.col("speaker") == F.col("perspective"), F.lit(f"{START}assistant\n")
    ).otherwise(F.concat(F.lit(f"{START}user name="), spoken_name(), F.lit("\n")))
    # lengths of a message in a perspective follow from its speaker and text alone, so sums are made before the rotation
    own = F.length("text")
    tail = len(END) + 1
    as_user = own + F.when(F.col("speaker") == "system", len(START) + 7).otherwise(len(START) + 11 + F.length(spoken_name())) + tail
    as_self = own + F.when(F.col("speaker") == "system", len(START) + 7).otherwise(len(START) + 10) + tail
    sized = said.withColumns({"other_size": as_user.cast("long"), "gain": (as_self - as_user).cast("long")})

    # within a chunk: prefix sums as every other's perspective, and corrections for the own messages
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "speaker", "text")
    mine = Window.partitionBy("conv_id", "chunk", "perspective").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"before": F.coalesce(F.sum("other_size").over(inside), F.lit(0)), "at": F.row_number().over(order) - 1})

    totals = sized.groupBy("conv_id", "chunk").agg(F.sum("other_size").alias("size"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = totals.select(
        "conv_id", "chunk", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("chunk_start"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("chunk_n")
    )
    gains = sized.where("speaker <> 'system'").groupBy("conv_id", "chunk", F.col("speaker").alias("perspective")).agg(F.sum("gain").alias("g"))
    every = chunks.alias("c").join(speakers.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id"))).select("c.*", "perspective")
    over_mine = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    e, g = every.alias("e"), gains.alias("g")
    starts = e.join(
        g, F.col("e.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("e.chunk") == F.col("g.chunk")) & (F.col("e.perspective") == F.col("g.perspective")), "left"
    ).select("e.*", "g.g").select(
        "conv_id", "chunk", "perspective", "chunk_n",
        (F.col("chunk_start") + F.coalesce(F.sum("g").over(over_mine), F.lit(0))).alias("chunk_start"),
    )

    p, s = placed.alias("p"), starts.alias("s")
    turned = p.join(s, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.chunk") == F.col("s.chunk"))).select(
        "p.*", "s.perspective", "s.chunk_start", "s.chunk_n"
    )
    own_gain = F.when(F.col("speaker") == F.col("perspective"), F.col("gain")).otherwise(F.lit(0))
    shifted = turned.withColumn("mine", own_gain).withColumn("start", F.col("chunk_start") + F.col("before") + F.coalesce(F.sum("mine").over(mine), F.lit(0)))
    trained = F.col("speaker") == F.col("perspective")
    return shifted.withColumns({"head": heads, "trained": trained}).select(
        "conv_id", "perspective", (F.col("chunk_n") + F.col("at")).cast("long").alias("position"), "turn", "speaker",
        F.concat("head", "text", F.lit(f"{END}\n")).alias("rendered"),
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("head") + F.length("text") + tail).cast("long").alias("end"),
        (F.col("start") + F.length("head")).cast("long").alias("mask_start"),
        (F.col("start") + F.length("head") + F.when(F.col("trained"), F.length("text") + len(END)).otherwise(0)).cast("long").alias("mask_end"),
        "trained",
    )


def assembled(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, rendering, masks: whole dialogues, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered", "trained", "mask_start", "mask_end")))
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select(
        "conv_id", "perspective", F.array_join("parts.rendered", "").alias("rendering"),
        F.transform(F.filter("parts", lambda x: x.trained), lambda x: F.struct(x.mask_start.alias("start"), x.mask_end.alias("end"))).alias("masks"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
seen AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
turned AS (
  SELECT m.*, s.perspective, m.speaker = s.perspective AS trained,
    row_number() OVER (PARTITION BY m.conv_id, s.perspective ORDER BY m.turn NULLS FIRST, m.speaker, m.text) - 1 AS position,
    CASE WHEN m.speaker = 'system' THEN '{START}system' || chr(10) WHEN m.speaker = s.perspective THEN '{START}assistant' || chr(10)
      ELSE '{START}user name=' || translate(replace(m.speaker, '<|', '< |'), chr(10) || chr(13), '  ') || chr(10) END AS head
  FROM said m JOIN seen s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
made AS (SELECT *, head || text || '{END}' || chr(10) AS rendered FROM turned),
placed AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position) - length(rendered) AS start FROM made)
SELECT conv_id, perspective, position, turn, speaker, rendered, CAST(start AS BIGINT) AS start,
  CAST(start + length(rendered) AS BIGINT) AS "end", CAST(start + length(head) AS BIGINT) AS mask_start,
  CAST(start + length(head) + CASE WHEN trained THEN length(text) + {len(END)} ELSE 0 END AS BIGINT) AS mask_end, trained
FROM placed
"""
