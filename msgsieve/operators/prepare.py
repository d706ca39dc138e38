"""Whole-table text preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions import text as tx
from msgsieve.sources.schemas import SIGNAL_TYPES


def add_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the seven signals of the raw text; those not used later are pruned."""
    return df.withColumns(signal_values(text))


def signal_values(text: str = "text") -> dict[str, Column]:
    """The signals as typed columns by name."""
    return {name: value.cast(SIGNAL_TYPES[name]) for name, value in tx.signals(F.col(text)).items()}


def prepare(
    df: DataFrame,
    text: str = "text",
    tokenizer: str | tx.Tokenizer = "whitespace",
    stopwords: Sequence[str] = (),
    keep_signals: bool = True,
) -> DataFrame:
    """Add ``text_clean`` and the signals, then drop rows whose text is blank.

    One projection and one filter on the scan; no shuffle.  With the default
    tokeniser the filter looks at the raw text, so rows are not cleaned twice.
    """
    cleaned = tx.process(F.col(text), tokenizer, stopwords, keep_signals)
    if tokenizer == "whitespace" and not stopwords and keep_signals:
        kept = df.where(tx.has_content(F.col(text)))
        return add_signals(kept.withColumn("text_clean", cleaned), text)
    return drop_blank(add_signals(df.withColumn("text_clean", cleaned), text))


def drop_blank(df: DataFrame, column: str = "text_clean") -> DataFrame:
    """Keep rows whose text has something besides white space."""
    return df.where(F.length(F.trim(F.col(column))) > 0)


def signal_columns(df: DataFrame, names: Sequence[str] = tuple(fixed.SIGNALS)) -> list[Column]:
    """The named signals as doubles; absent columns and nulls count as 0."""
    return [
        (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)).alias(name)
        for name in names
    ]


def text_column(df: DataFrame, name: str = "text_clean") -> Column:
    """A text column with nulls as empty text."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)
