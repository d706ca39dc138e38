"""Exploration by class: means, histograms, samples, shuffled order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from msgsieve.functions.hashing import hash32


def signal_means(df: DataFrame, group: str, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean of each column per class."""
    return df.groupBy(group).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def histogram(df: DataFrame, group: str, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each class.

    The column is reduced to one row per distinct value before anything else,
    so the limits and the bins read counts, not messages.  The last bin includes
    the largest value; a class with one single value gets a bin half a unit wide
    to each side.
    """
    counts = (
        df.where(F.col(column).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    limits = counts.groupBy(group).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")
    )
    single = F.col("lo") == F.col("hi")
    # reading n here too lets Spark use one aggregation for limits and bins
    limits = limits.where(F.col("total") > 0).select(
        group,
        F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    at = F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    return (
        counts.join(limits, group)
        .withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
        .groupBy(group, "bin")
        .agg(F.sum("n").alias("n"))
    )


def sample_per_class(
    df: DataFrame,
    group: str,
    key: str,
    text: str = "text",
    n: int = 3,
    seed: int = 42,
    preview: int = 100,
) -> DataFrame:
    """``n`` reproducible sample rows per class, the text shortened for display.

    Only (class, key, hash) is ranked; tasks drop all but their own best ``n``
    per class before the shuffle.  The few keys that remain select the texts.
    """
    order = Window.partitionBy(group).orderBy("_hash", key)
    picked = (
        df.select(group, key, hash32(seed, F.col(key)).alias("_hash"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(key, "rank")
    )
    return df.join(picked, key).select(
        group, "rank", key, F.substring(text, 1, preview).alias(text)
    )


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(hash32(seed, F.col(key)), key)
