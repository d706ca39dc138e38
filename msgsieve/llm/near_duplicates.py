"""Near-duplicate documents: banded MinHash, odd sketches and exact confirmation.

A document's set holds the hashes of its different ``size``-word shingles, ASCII case
ignored; a shorter text is one shingle.  Two documents are linked if
100 * intersection >= 80 * union.

1. Each set gives ``BANDS * ROWS`` MinHash samples.  Bands of ``ROWS`` samples propose
   candidates: sets of similarity 0.8 share no band with probability 5e-8.
2. The bottom-k MinHash sample (the ``SKETCHED`` smallest hashes; smaller sets as a
   whole) is folded into an odd sketch, a bitmap of ``SKETCH_BITS`` parities.  The XOR of
   two sketches has at most as many bits as the samples have different elements, and
   only few less, so it tells high similarities apart precisely.  A candidate is dropped
   if it has more than similar enough sets could have: for whole sets no link can be
   lost, for sampled ones the limit lies six standard deviations beyond.
3. What is left is confirmed on the full sets.

Equal sets are one node from the start.  In a band's bucket every member is first
compared with the smallest id only, which joins large groups with as many comparisons
as members.  A bucket whose members are then in one component needs no more.  In the
others, members outside the bucket's largest component are compared with all members of
other components, so no link between components is lost; sketches are compared inside
the join and only pairs that pass leave it.

Cases: a null or blank text has the empty set and links with nothing; rows with equal
``doc_id`` are one node; rows without ``doc_id`` link with nothing, have no component
and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.llm.components import components
from msgsieve.llm.tables import as_documents, read
from msgsieve.llm.words import (
    Words, as_signed, blocks, mix, release_memory, sequence_hashes, text_bytes, valid_starts,
)
from msgsieve.session import cut_lineage

PERCENT = 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCHED, SKETCH_BITS = 1024, 2048
# Six standard deviations of the different elements in two samples at J = 0.8, which has
# SKETCHED * 8/9 of them in common on average.
MARGIN = int(12 * (SKETCHED * 8 / 81) ** 0.5)
SHINGLE_BASE = 0x14057B7EF767814F

_random = np.random.default_rng(20240607)
_FACTOR = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of all rows of a block, sorted within rows, and each row's bounds."""
    hashes, count = words.hashes(), len(words.first) - 1
    whole = sequence_hashes(hashes, size, SHINGLE_BASE)
    valid = valid_starts(words.first, size, len(whole))
    rows, values = words.rows()[: len(whole)][valid], whole[valid]
    lengths = np.diff(words.first)
    for r in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():
        part = hashes[words.first[r] : words.first[r + 1]]
        rows, values = np.append(rows, r), np.append(values, sequence_hashes(part, len(part), SHINGLE_BASE))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(count + 1))


def minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of samples for each non-empty set beginning at ``starts``."""
    top = (values >> np.uint64(32)).astype(np.uint32)
    result = np.empty((len(starts), SAMPLES), dtype=np.uint32)
    for i in range(SAMPLES):
        result[:, i] = np.minimum.reduceat(top * _FACTOR[i] + _SHIFT[i], starts)
    return result


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS))
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, row::ROWS])
    return keys


def odd_sketches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of the bottom-k sample of each sorted set, as 64-bit words."""
    taken = np.minimum(sizes, SKETCHED)
    ends = np.cumsum(taken)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - taken), taken)
    bits = (mix(values[at]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits += SKETCH_BITS * np.repeat(np.arange(len(starts)), taken)
    odd = np.bincount(bits, minlength=SKETCH_BITS * len(starts)) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64).reshape(len(starts), -1)


def describe_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, n_shingles, two checksums of the set, band keys and sketch of each row, written once."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in blocks(offsets):
                count = high - low
                values, bounds = shingle_sets(Words(data, offsets[low : high + 1], lower=True), size)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                starts = bounds[full]
                sums = np.zeros((2, count), dtype=np.uint64)
                samples = np.zeros((0, SAMPLES), dtype=np.uint32)
                if len(full):
                    sums[0, full] = np.add.reduceat(values, starts)
                    sums[1, full] = np.add.reduceat(mix(values ^ np.uint64(SHINGLE_BASE)), starts)
                    samples = minhash(values, starts)
                keys, sketch = as_signed(band_keys(samples)), as_signed(odd_sketches(values, starts, sizes[full]))
                some = np.concatenate([[0], np.cumsum(sizes > 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, count), pa.array(sizes, pa.int64()),
                    pa.array(as_signed(sums[0])), pa.array(as_signed(sums[1])),
                    pa.ListArray.from_arrays(pa.array(some * BANDS), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(pa.array(some * (SKETCH_BITS // 64)), pa.array(sketch.ravel())),
                ], ["id", "n_shingles", "c0", "c1", "bands", "sketch"])
        release_memory()

    return cut_lineage(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        describe, "id bigint, n_shingles bigint, c0 bigint, c1 bigint, bands array<bigint>, sketch array<bigint>"), "sets")


def close(a: str, b: str) -> Column:
    """Whether sizes and sketches of two sets allow a link."""
    flips = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i))))
                 for i in range(SKETCH_BITS // 64)), F.lit(0))
    small, large = (f(f"{a}.n_shingles", f"{b}.n_shingles") for f in (F.least, F.greatest))
    return (100 * small >= PERCENT * large) & (flips <= most_flips(small, large))


def most_flips(small: Column, large: Column) -> Column:
    """How many elements the samples of two similar enough sets of these sizes can differ in."""
    common = (small + large) * PERCENT / (100 + PERCENT) * F.least(F.lit(1.0), SKETCHED / large)
    sampled = F.when(large > SKETCHED, F.lit(MARGIN)).otherwise(0)
    return F.least(small, F.lit(SKETCHED)) + F.least(large, F.lit(SKETCHED)) - 2 * common + sampled + 1e-6


def confirm(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough; written once."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch.column(i)) for i in (2, 3)]
            linked = np.zeros(batch.num_rows, dtype=bool)
            for low, high in blocks(sides[0][1] + sides[1][1]):
                one, other = (shingle_sets(Words(d, o[low : high + 1], lower=True), size) for d, o in sides)
                for r in range(high - low):
                    x, y = (v[b[r] : b[r + 1]] for v, b in (one, other))
                    at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                    common = int((x[at] == y).sum()) if len(x) else 0
                    linked[low + r] = common and 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))
        release_memory()

    pairs = cut_lineage(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = cut_lineage(ids, "candidate-ids")  # so that its size is known before texts are shuffled for the join
    texts = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(ids, "id"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return cut_lineage(both.mapInArrow(exact, "a bigint, b bigint"), "confirmed")


def first_pairs(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Every member of a bucket with its smallest id."""
    least = cut_lineage(buckets.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where(
        "a < z").drop("z"), "buckets")
    pairs = buckets.join(least, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    one, other = (sets.select(F.col("id").alias(c), F.struct("n_shingles", "sketch").alias(f"s{c}")) for c in "ab")
    return pairs.join(other, "b").join(one, "a").where(close("sa", "sb")).select("a", "b")


def later_pairs(buckets: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs from different components of a bucket that its smallest id has not joined."""
    placed = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    mixed = cut_lineage(counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.min("first").alias("first"),
        F.count("*").alias("parts"), F.sum("n").alias("members")).where("parts > 1 AND members > 2").drop(
        "parts", "members"), "mixed")
    members = cut_lineage(placed.join(mixed, "key").where("id <> first").join(
        sets.select("id", "n_shingles", "sketch"), "id"), "members")
    one, other = members.where("component <> largest").alias("x"), members.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
    joined = one.join(other, (F.col("x.key") == F.col("y.key")) & differ & close("x", "y"))
    return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def classes(docs: DataFrame, size: int) -> DataFrame:
    """id, n_shingles and component_id of every row of ``docs``."""
    described = describe_sets(docs, size)
    # a written table, as adaptive execution splits a large group only between two plain sides
    leaders = cut_lineage(described.where("id IS NOT NULL AND n_shingles > 0").groupBy("c0", "c1", "n_shingles").agg(
        F.min("id").alias("leader")), "first-of-equals")
    own = cut_lineage(described.select("id", "n_shingles", "c0", "c1").join(
        leaders, ["c0", "c1", "n_shingles"], "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("leader", "id")).alias("leader")), "leaders")
    heads = own.where("id = leader AND n_shingles > 0").select("id", "n_shingles").distinct()
    sets = cut_lineage(described.join(heads, ["id", "n_shingles"]).select("id", "n_shingles", "bands", "sketch"), "heads")
    buckets = sets.select("id", F.explode("bands").alias("key"))

    links = confirm(first_pairs(buckets, sets), docs, size)
    labels = cut_lineage(components(links), "labels")
    more = confirm(later_pairs(buckets, sets, labels), docs, size)
    if not more.isEmpty():
        labels = cut_lineage(components(links.unionByName(more)), "labels")
    found = own.join(labels.withColumnRenamed("id", "leader"), "leader", "left")
    return found.select("id", "n_shingles", F.coalesce("component", "leader").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: one document of every class of near duplicates on five words."""
    docs = as_documents(docs)
    ids = cut_lineage(classes(docs, 5).where("id IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(
        F.max("component_id").alias("_class"), F.count("*").alias("_rows")), "class-ids")
    # each written, so that its size is known before texts are shuffled for the joins
    dropped = cut_lineage(ids.where("_id <> _class").select("_id"), "dropped-ids")
    repeated = cut_lineage(ids.where("_id = _class AND _rows > 1").select("_id"), "repeated-ids")
    same = F.col("doc_id") == F.col("_id")
    kept = docs.join(dropped, same, "left_anti")
    several = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, same, "left_anti").unionByName(several)


def op10_odd_sketches(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(read(spark, folder, "documents"), 4)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s
  FROM tokens, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS joint
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * joint >= 80 * (p.n + q.n - joint)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(id, far) AS (
  SELECT doc_id, doc_id FROM tokens UNION SELECT id, y FROM reach JOIN ways ON far = x
), least AS (
  SELECT id, min(far) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM tokens JOIN least ON id = doc_id LEFT JOIN sizes USING (doc_id)
"""
