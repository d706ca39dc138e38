"""Removal of passages that already occur in a document with a smaller id.

A window is ``WINDOW`` consecutive words.  Each window is represented by the smallest
hash of its ``GRAM``-word sequences; neighbouring windows mostly share it, so a document
has about one such representative in twenty words, and equal windows have equal ones.

1. Count-min prefilter: every partition counts its representatives in an array of cells of
   fixed width, twice, by different hashes.  The partitions' arrays are added block by block
   of cells.  A cell counts all that fall into it, so its count is never too small: what has
   a count below two in either array occurs once, and goes.  Only one bit a cell is sent to
   all tasks, and no representative is shuffled.  The width is the power of two above
   ``CELLS_EACH`` cells a representative, ``MOST_WIDTH`` at most: 2 x 64 MB in a task,
   2 x 8 MB sent.  Beyond some 10^8 representatives the arrays fill up and pass ever more;
   that costs the next step its size today, and no result.
2. Exact grouping: those estimated to be repeated are grouped by their 64-bit hashes, and
   documents that keep a representative emit only its windows, with a 128-bit hash each;
   each hash gets the smallest document id.
3. Windows of larger ids are covered, and the documents that have some are cut.

Copies of whole documents are set apart first by a checksum of their words, so large
groups of copies go through the passes as one document.

Cases: a null or blank text has no words and keeps the checksum of nothing; texts shorter
than a window lose nothing; a null ``doc_id`` counts as larger than any other; rows with
equal ``doc_id`` do not remove from each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.llm.tables import read
from msgsieve.llm.words import (
    Joined, Words, as_signed, blocks, mix, sequence_hashes, sliding_minimum, text_bytes, valid_starts,
)
from msgsieve.session import cut_lineage

WINDOW = 50
GRAM = 10
CELLS_EACH = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 26
BLOCK_CELLS = 1 << 16
FULL = 255  # cells of one byte stay there
SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
LAST_ID = (1 << 63) - 1
GRAM_BASE = 0x2545F4914F6CDD1D
KEY_BASES = (0x369DEA0F31A53F85, 0x9FB21C651E98DF25)
NOTHING = hashlib.sha256(b"").hexdigest()


def representatives(hashes: np.ndarray, size: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For the window at every word, the smallest hash of its ``gram``-word sequences."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    return sliding_minimum(sequence_hashes(hashes, gram, GRAM_BASE), size - gram + 1)


def _lists(rows: np.ndarray, values: np.ndarray, count: int, kind: pa.DataType) -> pa.ListArray:
    """``values`` as one list per row; ``rows`` is sorted."""
    offsets = np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in blocks(offsets):
            words, count = Words(data, offsets[low : high + 1]), high - low
            least = representatives(words.hashes())
            whole = valid_starts(words.first, WINDOW, len(least))
            rows, least = words.rows()[: len(least)][whole], least[whole]
            new = np.ones(len(least), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            rows, least = rows[new], least[new]
            order = np.lexsort((least, rows))
            rows, least = rows[order], least[order]
            new = np.ones(len(least), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            joined = Joined(words)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(low, count), batch.column("text_key").slice(low, count),
                pa.array(np.diff(words.first), pa.int64()),
                pa.array([hashlib.sha256(joined.row(r)).digest() for r in range(count)], pa.binary()),
                _lists(rows[new], as_signed(least[new]), count, pa.int64()),
            ], ["id", "text_key", "n_words", "checksum", "least"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed representatives, with their 128-bit keys."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        listed = batch.column("least")
        wanted, bounds = listed.values.to_numpy(zero_copy_only=False).view(np.uint64), listed.offsets.to_numpy()
        for low, high in blocks(offsets):
            words, count = Words(data, offsets[low : high + 1]), high - low
            hashes = words.hashes()
            least = representatives(hashes)
            whole = valid_starts(words.first, WINDOW, len(least))
            marked = np.zeros(len(least), dtype=bool)
            for r in range(count):
                begin, end = int(words.first[r]), min(int(words.first[r + 1]), len(least))
                marked[begin:end] = np.isin(least[begin:end], wanted[bounds[low + r] : bounds[low + r + 1]])
            at = np.flatnonzero(marked & whole)
            rows = words.rows()[at]
            keys = [as_signed(sequence_hashes(hashes, WINDOW, base)[at]) if len(at) else at for base in KEY_BASES]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(low, count), batch.column("text_key").slice(low, count),
                batch.column("text").slice(low, count),
                _lists(rows, (at - words.first[rows]).astype(np.int32), count, pa.int32()),
                _lists(rows, keys[0], count, pa.int64()), _lists(rows, keys[1], count, pa.int64()),
            ], ["id", "text_key", "text", "place", "k0", "k1"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the listed windows cover."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        listed = batch.column("places")
        places, bounds = listed.values.to_numpy(), listed.offsets.to_numpy()
        for low, high in blocks(offsets):
            words, count = Words(data, offsets[low : high + 1]), high - low
            step = np.zeros(len(words) + 1, dtype=np.int64)
            for r in range(count):
                own = np.unique(places[bounds[low + r] : bounds[low + r + 1]]) + words.first[r]
                step[own] += 1
                step[own + WINDOW] -= 1
            removed = np.cumsum(step)[:-1] > 0
            left = Joined(words, ~removed)
            total = np.concatenate([[0], np.cumsum(removed)])[words.first]
            kept = [left.row(r) for r in range(count)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(low, count), batch.column("text_key").slice(low, count),
                pa.array(np.diff(total), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pa.array([k.decode() for k in kept]),
            ], ["id", "text_key", "n_removed", "kept_sha256", "kept_text"])


def cells(least: np.ndarray, seed: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(least * np.uint64(seed | 1) + np.uint64(seed)) & np.uint64(width - 1)).astype(np.int64)


def sketch_width(total: int) -> int:
    return min(max(1 << (CELLS_EACH * total).bit_length(), LEAST_WIDTH), MOST_WIDTH)


class Sketch:
    """Count-min arrays of one partition."""

    def __init__(self, width: int):
        self.width = width
        self.counts = [np.zeros(width, dtype=np.uint8) for _ in SEEDS]

    def add(self, least: np.ndarray) -> None:
        for counts, seed in zip(self.counts, SEEDS):
            at, times = np.unique(cells(least, seed, self.width), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, FULL)

    def parts(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Array, block, places and counts of the cells that are not zero, for each block that has some."""
        for row, counts in enumerate(self.counts):
            for block in range(0, self.width, BLOCK_CELLS):
                at = np.flatnonzero(counts[block : block + BLOCK_CELLS])
                if len(at):
                    yield row, block // BLOCK_CELLS, at.astype("<u2").tobytes(), counts[block + at].tobytes()


def sketches(profiles: DataFrame, width: int) -> DataFrame:
    """The arrays of all partitions in blocks: row, block, at, counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for batch in batches:
            sketch.add(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        rows = list(sketch.parts())
        for low in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows[low : low + 256]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                ["row", "block", "at", "counts"])

    return profiles.select("least").mapInArrow(count, "row int, block int, at binary, counts binary")


def merged(parts: DataFrame) -> DataFrame:
    """row, block and one bit for each of its cells: whether the partitions' counts add up to two or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault((row, block), np.zeros(BLOCK_CELLS, dtype=np.uint8))
                at = np.frombuffer(at, dtype="<u2")
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts, dtype=np.uint8), FULL)
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                pa.array([np.packbits(v >= 2, bitorder="little").tobytes() for v in sums.values()], pa.binary())],
                ["row", "block", "bits"])

    return parts.repartition("row", "block").mapInArrow(add, "row int, block int, bits binary")


def estimated_repeated(profiles: DataFrame, width: int | None = None) -> DataFrame:
    """id, text_key and the representatives whose estimated count is two or more, where there are any."""
    if width is None:
        width = sketch_width(profiles.agg(F.sum(F.size("least"))).first()[0] or 0)
    bits = np.zeros((len(SEEDS), max(width, BLOCK_CELLS) // 8), dtype=np.uint8)
    for part in merged(sketches(profiles, width)).collect():  # one bit a cell
        low = part["block"] * BLOCK_CELLS // 8
        bits[part["row"], low : low + BLOCK_CELLS // 8] = np.frombuffer(part["bits"], dtype=np.uint8)
    sent = profiles.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("least")
            sizes = np.diff(listed.offsets.to_numpy())
            least = listed.flatten().to_numpy(zero_copy_only=False)
            often = np.ones(len(least), dtype=bool)
            for seed, row in zip(SEEDS, sent.value):
                at = cells(least.view(np.uint64), seed, width)
                often &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            rows = np.repeat(np.arange(len(sizes)), sizes)[often]
            kept = pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("text_key"), _lists(rows, least[often], len(sizes), pa.int64()),
            ], ["id", "text_key", "least"])
            yield kept.filter(pa.array(np.bincount(rows, minlength=len(sizes)) > 0))

    return profiles.select("id", "text_key", "least").mapInArrow(
        keep, "id bigint, text_key bigint, least array<bigint>")


def repeated(profiles: DataFrame, width: int | None = None) -> DataFrame:
    """id and text_key with the representatives that several rows of ``profiles`` have."""
    left = cut_lineage(estimated_repeated(profiles, width).select(
        "id", "text_key", F.explode("least").alias("least")), "sketched")
    many = cut_lineage(left.groupBy("least").count().where("count > 1").select("least"), "grouped")
    return left.join(many, "least", "left_semi").groupBy("id", "text_key").agg(F.collect_list("least").alias("least"))


def cut_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept_text where something was removed.

    Where nothing was removed, ``kept_text`` is null and the words are those of the text.
    """
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    keyed = docs.select(number.alias("id"), F.xxhash64("text").alias("text_key"), "text")
    profiles = cut_lineage(keyed.mapInArrow(
        _profile, "id bigint, text_key bigint, n_words bigint, checksum binary, least array<bigint>"), "profiles")

    copies = cut_lineage(profiles.groupBy("checksum").agg(F.min("id").alias("first_id")), "first-of-equals")
    own = profiles.join(copies, "checksum")
    first = cut_lineage(own.where("id = first_id").select("id", "text_key", "least"), "firsts")
    wanted = cut_lineage(repeated(first), "repeated")

    texts = keyed.where("text IS NOT NULL").join(wanted, ["id", "text_key"]).select("id", "text_key", "text", "least")
    found = cut_lineage(texts.mapInArrow(
        _windows, "id bigint, text_key bigint, text string, place array<int>, k0 array<bigint>, k1 array<bigint>"),
        "windows")

    windows = found.select("id", "text_key", F.inline(F.arrays_zip("place", "k0", "k1")))
    earliest = cut_lineage(windows.groupBy("k0", "k1").agg(
        F.min("id").alias("earliest"), F.max("id").alias("latest")).where("earliest < latest").drop("latest"), "earliest")
    covered = windows.join(earliest, ["k0", "k1"]).where("id > earliest").groupBy("id", "text_key").agg(
        F.collect_list("place").alias("places"))
    cut = found.select("id", "text_key", "text").join(covered, ["id", "text_key"]).select(
        "id", "text_key", "text", "places").mapInArrow(
        _cut, "id bigint, text_key bigint, n_removed bigint, kept_sha256 string, kept_text string")
    cut = cut.dropDuplicates(["id", "text_key"])  # equal rows were cut alike

    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    result = own.drop("least").join(cut, ["id", "text_key"], "left")
    return result.select(
        F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("checksum")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op2_count_min_passages(spark: SparkSession, folder: str) -> DataFrame:
    return cut_passages(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS key
  FROM tokens, unnest(range(1, len(words) - 48)) AS t(i)
), earliest AS (
  SELECT key, min(doc_id) AS first_id FROM windows GROUP BY key
), covered AS (
  SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN earliest USING (key), range(0, 50) AS r(k)
  WHERE doc_id > first_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM tokens
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS body
  FROM each ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM tokens LEFT JOIN kept USING (doc_id)
"""
