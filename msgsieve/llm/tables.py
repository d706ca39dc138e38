"""Reading the driver's tables and putting intermediate results into shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_documents(df: DataFrame) -> DataFrame:
    """Exactly the columns of ``documents``; other columns go, whatever their names."""
    return df.select(*DOCUMENT_COLUMNS)
