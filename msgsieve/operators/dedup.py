"""Exact duplicates of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgsieve.functions.hashing import text_key


# Of the 63 bits of a row's place, those below the priority.
ORDINAL_BITS = 55


def keep_first(df: DataFrame, text: str = "text", priority: str = "priority", ordinal: str = "ordinal") -> DataFrame:
    """One row per text, the first by ``priority`` (below 256) and ``ordinal`` (0 to 2 ** 55 - 1).

    A row's place is one number, so finding the first place of each text is a hash
    aggregation of fixed-width values that shrinks a frequent text inside each
    task.  The winning rows are then fetched by place and text key, which spreads
    the rows of a frequent text too.  Equal rows with equal places count once.
    """
    place = F.shiftleft(F.col(priority).cast("bigint"), ORDINAL_BITS) + F.col(ordinal).cast("bigint")
    keyed = df.withColumns({"_key": text_key(F.col(text)), "_place": place})
    first = keyed.groupBy("_key").agg(F.min("_place").alias("_place"))
    return keyed.join(first, ["_place", "_key"]).drop("_place", "_key").distinct().select(*df.columns)


def duplicate_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows beyond the first of each text; all null texts count as one text."""
    return df.agg(
        (
            F.count(F.lit(1))
            - F.count_distinct(text_key(F.col(text)))
            - F.max(F.when(F.col(text).isNull(), 1).otherwise(0))
        ).alias("n_duplicates")
    ).select(F.coalesce("n_duplicates", F.lit(0)).cast("bigint").alias("n_duplicates"))
