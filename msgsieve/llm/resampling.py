"""Importance resampling of documents towards the word use of a target table.

* Words by byte translate and split: one 256-byte table lower-cases A-Z and blanks every
  other ASCII byte but digits and letters, ``bytes.split`` yields the words.  Bytes from
  0x80 on belong to words, so UTF-8 letters are never cut.
* Features are the runs of one to ``GRAMS`` words joined by one space.  A run's CRC-32 is
  chained: the checksum of the run without its last word is the seed for that word, so no
  joined string is ever built.  The checksum modulo ``BUCKETS`` is the feature's bucket.
* Every partition reduces its buckets in a Counter, at most ``BUCKETS`` rows leave it.
  The summed counts of both tables give a gain per bucket: the log of how much more of the
  target falls into it, in thousandths.  These ``BUCKETS`` numbers are all that tasks share.
* A document weighs the mean gain of its features.  Gumbel noise from a hash of its id makes
  the documents with the highest scores a draw without replacement in proportion to the
  weights.  Ranks come from range partitions' totals, so no task holds more than a range.

Cases: a null or empty text has no features, weighs 0 and is never drawn, as are texts of
fewer than ``LEAST_WORDS`` words; a null ``doc_id`` is hashed as an empty one and comes first
among equal scores; repeated rows are documents each, and those equal in score and id are
ranked by their number of features; an empty table gives an empty result; an empty target
leaves the gains that the ``BUCKETS`` added counts give; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgsieve.llm.tables import read
from msgsieve.session import cut_lineage

GRAMS = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
ROWS = 256  # texts that become Python objects at a time

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def checksums(words: list[bytes], grams: int = GRAMS) -> list[int]:
    """CRC-32 of every run of one to ``grams`` words joined by single spaces."""
    runs = list(map(crc32, words))
    found = runs
    if grams > 1:
        spaced = [b" " + w for w in words]
        for size in range(1, grams):
            runs = list(map(crc32, islice(spaced, size, None), runs))  # a run's checksum seeds its next word
            found = found + runs
    return found


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """UTF-8 bytes of the texts, a few at a time."""
    raw = column.cast(pa.large_string()).cast(pa.large_binary())
    for low in range(0, len(raw), ROWS):
        yield [x or b"" for x in raw.slice(low, ROWS).to_pylist()]


def bucket_counts(table: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all texts that fall into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for raws in _texts(batch.column(0)):
                for raw in raws:
                    total.update([c % buckets for c in checksums(words_of(raw), grams)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    partial = table.select("text").where("text IS NOT NULL").mapInArrow(count, "bucket int, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """What a feature of each bucket adds to a document's weight, in thousandths of a nat."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
        for b in range(buckets)
    ]


def weigh(docs: DataFrame, gain: list[int], grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers

    def mean_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        buckets = len(gain)
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for raws in _texts(batch.column(1)):
                for raw in raws:
                    words = words_of(raw)
                    found = checksums(words, grams)
                    n_words.append(len(words))
                    n_features.append(len(found))
                    weights.append(sum([gain[c % buckets] for c in found]) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        mean_gains, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id: the same wherever and whenever it is drawn."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the highest scores among ``eligible`` rows, else null.

    Range partitions in order of score are written; a row's rank is its place in its own
    range and the sizes of those before it, one row a range.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    ranges = cut_lineage(
        scored.where("eligible").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "draw-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"),
        F.sum("count").over(Window.partitionBy()).alias("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("earlier")
    placed = ranges.join(F.broadcast(totals), "part").withColumn("place", place)  # totals: one row a range
    drawn = F.when(F.col("place") <= F.expr(f"{percent} * n div 100"), F.col("place")).cast("bigint")
    rest = scored.where("NOT eligible").withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", drawn).select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; ``rank`` is null for rows not drawn.

    Two passes over the texts: the gains need the counts of all documents.
    """
    source = dict(map(tuple, bucket_counts(docs).collect()))  # BUCKETS rows at most
    wanted = dict(map(tuple, bucket_counts(target).collect()))
    weighed = weigh(docs, gains(source, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = cut_lineage(weighed.withColumn("eligible", F.col("n_words") >= LEAST_WORDS).drop("n_words"), "scored")
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The drawn rows of ``docs`` for training; needs unique ids."""
    return docs.join(ranks.where("rank IS NOT NULL").select("doc_id"), "doc_id", "left_semi")


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


# CRC-32 by its table, once for each different word and pair of words.
SQL = r"""
WITH RECURSIVE poly(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, 1 AS source, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), 0, NULL, text FROM benchmark
), tokens AS (
  SELECT r, source, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT r, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM tokens
), counted AS (SELECT r, source, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table
), both_tables AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE source = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE source = 0), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g
  FROM both_tables
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total
  FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE source = 1 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM tokens LEFT JOIN weighed USING (r) WHERE source = 1
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    count(*) FILTER (WHERE n_words >= 20) OVER () AS n
  FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
