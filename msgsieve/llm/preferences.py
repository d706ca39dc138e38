"""Preference pairs: a shared prompt rendered once, and two completions with loss masks.

The prompt is the longest run of turns, from the first on, that the chosen and the
rejected conversation have in common.  What follows is each side's completion; in it,
only assistant texts and their end marks count for the loss.

Turns are aligned by their number.  A pair is cut into chunks of ``CHUNK`` turn numbers,
each of which is one row, so a conversation of any length is spread over tasks and no
row holds more than ``CHUNK`` turns a side; most pairs are one row.

Cases: a null role counts as ``unknown`` and a null text as empty; a null turn number
comes before all others; of several rows with the same conversation and turn number the
smallest (role, text) counts, so repeated rows change nothing; rows without a
conversation belong to no pair and are left out; a conversation without partner has an
empty prompt, if its partner has no turns, and an empty other side; equal conversations
are all prompt; an empty table gives an empty result; other columns are ignored.
Marks inside texts are broken up by a space, so no text can open or close a turn, and texts
that differ stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.functions.evaluation import bind
from msgsieve.llm.tables import read

CHUNK = 512
NO_TURN = -1
END = "<|end|>"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def safe(text: Column) -> Column:
    """One more space between ``<`` and ``|``, so that different texts stay different."""
    return F.regexp_replace(text, r"<( *)\|", r"< $1|")


def rendered(turn: Column) -> Column:
    return F.concat(head(turn["role"]), safe(turn["text"]), F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """Character ranges of the rendered turns that count for the loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(head(turn["role"]))
        end = begin + F.length(safe(turn["text"])) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"),
                        F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def first_difference(chosen: Column, rejected: Column) -> Column:
    """The smallest turn number at which two sorted lists of turns differ, null if none."""
    def at(i: Column) -> Column:
        one, other = F.get(chosen, i), F.get(rejected, i)
        return F.when(~one.eqNullSafe(other), F.least(one["turn"], other["turn"]))

    places = F.sequence(F.lit(0), F.greatest(F.size(chosen), F.size(rejected)) - 1)
    return F.array_min(F.transform(places, at))


def aligned(turns: DataFrame) -> DataFrame:
    """pair_id, chunk and both sides' turns in order, from pair_id, chosen, turn, role and text."""
    number = F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN))
    clean = turns.where(F.col("pair_id").isNotNull()).select(
        "pair_id", "chosen", number.alias("turn"), F.floor(number / CHUNK).cast("bigint").alias("chunk"),
        F.struct(F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
                 F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("said"))
    single = clean.groupBy("pair_id", "chunk", "chosen", "turn").agg(F.min("said").alias("said"))
    turn = F.struct("turn", F.col("said.role").alias("role"), F.col("said.text").alias("text"))
    return single.groupBy("pair_id", "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("rejected"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair and chunk: prompt, chosen, rejected and the loss spans of both.

    ``turns``: pair_id, chosen (boolean), turn, role, text.  A chunk's texts follow those
    of the chunk before; spans count from the chunk's own start.
    """
    both = aligned(turns).withColumn("differs", first_difference(F.col("chosen"), F.col("rejected")))
    ends = both.groupBy("pair_id").agg(F.min("differs").alias("prompt_end"))

    def shared(t: Column) -> Column:
        return F.col("prompt_end").isNull() | (t["turn"] < F.col("prompt_end"))

    parts = both.join(ends, "pair_id").select(
        "pair_id", "chunk", F.filter("chosen", shared).alias("p"),
        F.filter("chosen", lambda t: ~shared(t)).alias("c"), F.filter("rejected", lambda t: ~shared(t)).alias("r"))
    return parts.select(
        "pair_id", "chunk", F.size("p").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c")).alias("chosen_loss"), loss_spans(F.col("r")).alias("rejected_loss"))


def branched(conversations: DataFrame) -> DataFrame:
    """Turns of pairs that branch: conversation 2k, and the same up to a turn from which 2k + 1 goes on.

    That turn is after the first and not after the last that both have, by a hash of the pair.
    Where one of them is missing, nothing is shared and its side is empty.
    """
    pair = F.floor(F.col("conv_id") / 2).cast("bigint")
    own = conversations.where("conv_id IS NOT NULL").select(
        pair.alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("first"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    lasts = own.groupBy("pair_id").agg(
        F.max(F.when(F.col("first"), F.col("turn"))).alias("a"), F.max(F.when(~F.col("first"), F.col("turn"))).alias("b"))
    drawn = F.conv(F.substring(F.sha2(F.col("pair_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    branches = lasts.select("pair_id", F.when(
        both, 1 + drawn % F.greatest(F.lit(1), F.least("a", "b"))).otherwise(NO_TURN).alias("branch"))
    shared = F.coalesce("turn", F.lit(NO_TURN)) < F.col("branch")
    sides = (F.when(F.col("first") & shared, F.array(F.lit(True), F.lit(False))).when(F.col("first"), F.array(F.lit(True)))
             .when(~shared, F.array(F.lit(False))))
    return own.join(branches, "pair_id").select("pair_id", F.explode(sides).alias("chosen"), "turn", "role", "text")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


def op7_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return format_pairs(branched(read(spark, folder, "conversations"))).select(
        "pair_id", "chunk", F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"), "prompt", "chosen",
        "rejected", as_text(F.col("chosen_loss")).alias("chosen_loss"),
        as_text(F.col("rejected_loss")).alias("rejected_loss"))


SQL = rf"""
WITH lasts AS (
  SELECT conv_id // 2 AS pair_id, max(turn) FILTER (conv_id % 2 = 0) AS a, max(turn) FILTER (conv_id % 2 = 1) AS b
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), branches AS (
  SELECT pair_id, CASE WHEN a IS NULL OR b IS NULL THEN {NO_TURN}
    ELSE 1 + ('0x' || sha256(pair_id::VARCHAR)[1:8])::BIGINT % greatest(1, least(a, b)) END AS branch FROM lasts
), own AS (
  SELECT pair_id, branch, conv_id % 2 AS conv, coalesce(turn, {NO_TURN}) AS turn, role, text
  FROM conversations JOIN branches ON conv_id // 2 = pair_id
), sides AS (
  SELECT *, 0 AS side FROM own WHERE conv = 0
  UNION ALL SELECT *, 1 FROM own WHERE (conv = 0) = (turn < branch)
), single AS (
  SELECT pair_id, side, turn, min({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}}) AS said
  FROM sides GROUP BY ALL
), turns AS (
  SELECT pair_id, side, turn, floor(turn / {CHUNK})::BIGINT AS chunk, said.role AS role,
         '<|' || said.role || '|>' || chr(10) AS head,
         regexp_replace(said.text, '<( *)\|', '< \1|', 'g') || '{END}' AS body FROM single
), ends AS (
  SELECT pair_id, min(turn) FILTER (n < 2 OR one <> other) AS prompt_end FROM (
    SELECT pair_id, turn, count(*) AS n, min(head || body) AS one, max(head || body) AS other FROM turns GROUP BY ALL)
  GROUP BY pair_id
), placed AS (
  SELECT *, CASE WHEN prompt_end IS NULL OR turn < prompt_end THEN 'prompt' WHEN side = 0 THEN 'chosen'
            ELSE 'rejected' END AS part FROM turns JOIN ends USING (pair_id)
  WHERE side = 0 OR prompt_end <= turn
), spans AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, chunk, part ORDER BY turn)
            - length(body) - 1 AS begins FROM placed
)
SELECT pair_id, chunk, count(*) FILTER (part = 'prompt') AS n_prompt_turns,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(begins::BIGINT || '-' || (begins + length(body))::BIGINT, ',' ORDER BY turn)
         FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg(begins::BIGINT || '-' || (begins + length(body))::BIGINT, ',' ORDER BY turn)
         FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_loss
FROM spans GROUP BY pair_id, chunk
"""
