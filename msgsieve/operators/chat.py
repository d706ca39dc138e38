"""Conversation context and chat answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.replies import faq_answer

# Default instruction of the assistant; callers pass their own persona.
CHAT_PROMPT = (
    "You help people recognise spam, phishing and online fraud. Answer in Thai, "
    "briefly and kindly, and name the hotline 1599 when someone was deceived."
)

# Turns of one conversation handled by one window; longer ones are chained.
BLOCK = 10_000


def history(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    limit: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``history``: the last ``limit`` turns before each turn, oldest first.

    ``turn`` is a number that orders a conversation without ties.  A
    conversation is cut into blocks of turn numbers, so one that holds a third
    of all turns still spreads over many tasks.  Only conversations longer than
    a block hand the tail of a block (``limit`` turns) on to the next ones.
    """
    entry = F.struct(F.col("role"), F.col("text").alias("content"))
    blocked = turns.withColumn("_block", F.floor(F.col(turn) / block))
    here = Window.partitionBy(conversation, "_block").orderBy(turn)
    local = blocked.withColumns(
        {
            "_local": F.collect_list(entry).over(here.rowsBetween(-limit, -1)),
            "_last": F.lead(turn).over(here).isNull(),
        }
    )

    blocks = (
        turns.groupBy(conversation)
        .agg(F.min(turn).alias("_lo"), F.max(turn).alias("_hi"))
        .where(F.floor(F.col("_lo") / block) < F.floor(F.col("_hi") / block))
        .select(conversation)
    )
    tails = (
        local.where("_last")
        .select(conversation, "_block", _last_entries(F.concat("_local", F.array(entry)), limit).alias("_tail"))
        .join(blocks, conversation, "left_semi")
    )
    # Every block has a turn, so the tails of ``limit`` blocks always suffice.
    earlier = Window.partitionBy(conversation).orderBy("_block").rowsBetween(-limit, -1)
    carried = tails.select(
        conversation,
        "_block",
        _last_entries(F.flatten(F.collect_list("_tail").over(earlier)), limit).alias("_carried"),
    )
    none = F.array().cast("array<struct<role:string,content:string>>")
    return (
        local.join(carried, [conversation, "_block"], "left")
        .withColumn(
            "history",
            F.when(F.col("_carried").isNull(), F.col("_local")).otherwise(
                _last_entries(F.concat(F.coalesce("_carried", none), "_local"), limit)
            ),
        )
        .select(*turns.columns, "history")
    )


def _last_entries(entries: Column, limit: int) -> Column:
    """The last ``limit`` entries; slice alone returns nothing for short arrays."""
    return F.slice(entries, F.greatest(F.size(entries) - (limit - 1), F.lit(1)), F.lit(limit))


def chat_messages(history: Column, message: Column, system_prompt: str = CHAT_PROMPT, limit: int = 10) -> Column:
    """Message list of a chat request: system, last turns, the new message."""

    def entry(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.concat(
        F.array(entry("system", F.lit(system_prompt))),
        _last_entries(history, limit),
        F.array(entry("user", message)),
    )


def answers(
    questions: DataFrame,
    replies: DataFrame | None = None,
    message: str = "text",
    key: str = "message_id",
) -> DataFrame:
    """Reply and its source: the model's answer, else a listed answer, else a fixed one.

    ``replies`` has ``key`` and ``reply``, at most one row per question.
    """
    if replies is None:
        joined = questions.withColumn("_reply", F.lit(None).cast("string"))
    else:
        joined = questions.join(replies.select(key, F.col("reply").alias("_reply")), key, "left")
    listed = faq_answer(F.col(message))
    return (
        joined.withColumn("_faq", listed)
        .withColumns(
            {
                "reply": F.coalesce("_reply", "_faq", F.lit(fixed.CHAT_FALLBACK)),
                "source": F.when(F.col("_reply").isNotNull(), "llm")
                .when(F.col("_faq").isNotNull(), "faq")
                .otherwise("fallback"),
                "timestamp": F.current_timestamp(),
            }
        )
        .drop("_reply", "_faq")
    )
