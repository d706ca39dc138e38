"""Contiguous shards of equal bytes, cut from global prefix sums of sizes.

Rows are put in ``doc_id`` order by range partitioning.  Every partition's total
of bytes and rows is summed over the partitions before it, which gives each row
its global offset; row ``r`` goes to shard ``floor(middle(r) * shards / total)``.
Only one row per partition meets in one place.

Cases: a null text counts as no bytes, so its size is the fixed overhead; a null
``doc_id`` comes first; rows with equal ``doc_id`` are ordered by checksum and size
(rows equal in all three are interchangeable); an empty table gives an empty
result; other columns are ignored.  A row larger than a shard's target fills its
shard alone, and shards that its bytes cover stay empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgsieve.llm.tables import read
from msgsieve.session import cut_lineage

OVERHEAD_BYTES = 16
SHARDS = 40


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and checksum of each row; texts are not carried further."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD_BYTES).cast("bigint").alias("size"),
                       F.crc32(raw).alias("text_crc32"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, start (bytes before the row), shard and slot."""
    order = ["doc_id", "text_crc32", "size"]
    ranges = sized(docs).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = cut_lineage(ranges, "shard-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(totals, "part").select(
        *order, "total",
        (F.col("bytes_before") + F.sum("size").over(within) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.count("*").over(within) - 1).alias("row"),
    )
    middle = F.expr(f"(2 * start + size) * {shards} div (2 * total)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *order, "start", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def cuts(assigned: DataFrame) -> list[tuple[int, int]]:
    """The first ``doc_id`` of each shard, one pair a shard."""
    return [tuple(r) for r in assigned.groupBy("shard").agg(F.min("doc_id")).orderBy("shard").collect()]


def shard_of(doc_id: Column, first_ids: list[tuple[int, int]]) -> Column:
    """The shard of an id: shards are ranges of ids, so no join is needed."""
    return reduce(lambda found, cut: F.when(doc_id >= cut[1], cut[0]).otherwise(found), first_ids, F.lit(0))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as ``path/shard=N``, sorted by id within files.

    Needs unique ids, as a range of ids stands for a shard.
    """
    first_ids = cuts(assign(docs, shards))
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), first_ids))
    placed.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id").write.partitionBy(
        "shard").parquet(path)


def op4_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return assign(read(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# The checksum is the table-driven CRC-32 of the text's bytes, as this engine has none.
SQL = r"""
WITH RECURSIVE poly(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
), placed AS (
  SELECT *, least((2 * (sum(size) OVER before - size) + size) * 40 // (2 * sum(size) OVER ()), 39)::INTEGER AS shard
  FROM sized WINDOW before AS (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
