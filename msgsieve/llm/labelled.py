"""Which labelled rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, columns: list[str]) -> DataFrame:
    """Columns of at most ``most`` labelled documents outside the held-out fold, and ``label``.

    They are the rows with the smallest hashes of their ids, so the choice depends neither
    on partitions nor on retries.  Rows without id or label are not used; of several labels
    of a document the larger counts, of several rows of a document the one with the smallest hash.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_id")
    found = docs.select(*columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # ``most`` ids and labels
    first = F.min_by(F.struct(*columns), F.struct(F.xxhash64(*columns), *columns))
    return found.groupBy("_id", "label").agg(first.alias("_row")).select("_row.*", "label")
