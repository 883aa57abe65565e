"""Operator 5: multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant the dialogue is rendered once with that speaker as the assistant and the
others as named users.  A rendering is a table of segments, one per turn, that are the
dialogue's text when joined by ``start``; so a dialogue of any length is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that set the scene: they stay as they are and are nobody's perspective.
CONTEXT_ROLES = ("system",)
#: Turns of a conversation whose offsets are added up in one group.
TURNS = 256
END = "<|end|>\n"


def header(role: Column, name: Column) -> Column:
    """``<|role|>`` or ``<|role name=...|>`` and a line end."""
    named = F.concat(F.lit("<|"), role, F.lit(" name="), name, F.lit("|>\n"))
    return F.when(name.isNotNull(), named).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))


def rotate(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """(conv_id, perspective, turn, speaker, chat_role, name, segment, start, length, mask_start, mask_length).

    One row per turn and perspective.  ``start`` is the segment's offset in the rendering, in
    characters; the mask covers what the assistant says, its end sign included, and has length 0 in
    every other turn.  Turns are ordered by number, null first; turns of equal number by speaker, then text,
    and rows that repeat are turns of their own.  A null role is the speaker ``unknown``, a null text is
    empty, rows without conv_id are one conversation.  A conversation of context turns only has
    no participant and gives no rows.  Offsets are summed inside (conversation, perspective, stretch of
    turn numbers) and carried over by one row per stretch.
    """
    said = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(F.col(conv_id).alias("conv_id")).alias("key"),
    )
    is_context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    participants = said.where(~is_context).select("key", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    shown = (
        said.join(participants, "key")
        .withColumn("chat_role", F.when(own, "assistant").when(is_context, F.col("speaker")).otherwise("user"))
        .withColumn("name", F.when(~own & ~is_context, F.col("speaker")))
        .withColumn("head", F.length(header(F.col("chat_role"), F.col("name"))))
        .withColumn("segment", F.concat(header(F.col("chat_role"), F.col("name")), F.col("text"), F.lit(END)))
        .withColumn("length", F.length("segment").cast("bigint"))
        .withColumn("stretch", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
        .withColumn("part", F.struct("key", "perspective"))
    )
    before = Window.partitionBy("part").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        shown.groupBy("part", "stretch")
        .agg(F.sum("length").alias("total"))
        .select("part", "stretch", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    )
    inside = (
        Window.partitionBy("part", "stretch")
        .orderBy("turn", "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.col("carried") + F.sum("length").over(inside) - F.col("length")
    return (
        shown.join(carried, ["part", "stretch"])
        .withColumn("start", start)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "chat_role",
            "name",
            "segment",
            "start",
            "length",
            (F.col("start") + F.col("head")).alias("mask_start"),
            F.when(F.col("chat_role") == "assistant", F.col("length") - F.col("head"))
            .otherwise(0)
            .cast("bigint")
            .alias("mask_length"),
        )
    )
