"""Benchmark passages in documents: SimHash of item-sized windows, verified exactly.

Words are runs of letters and digits, ASCII case ignored.  A window has as many words as
the item it is compared with; its fingerprint is the 64-bit SimHash of its five-word
shingles, each weighted by how often it occurs.  Fingerprints are compared by multi-index
Hamming blocks: two that differ in at most ``RADIUS`` = 23 of 64 bits differ in at most
two bits of one of eight bytes at least, so looking up each byte within two bits finds
them all.  Candidates are then verified by the exact weighted Jaccard similarity
(sum of smaller / sum of larger shingle counts, 0.8 or more).  At similarity 0.8 the
expected distance is below 10 bits with a standard deviation of 3.

A window that shares no shingle with an item has similarity 0, so fingerprints are only
computed for windows that share one.  That loses nothing and spares most texts.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each of which is one
pass over the documents.  A block's findings are written and its index is destroyed before
the next is built, so what the driver and the tasks hold is bounded for any benchmark.

Cases: null and empty texts hold no passage, and null or empty items are found nowhere;
items below ``MIN_WORDS`` words say too little and are not searched; a document shorter
than an item is one window; repeated items are found each; of equally similar windows
the first counts; rows with equal ``doc_id`` share their findings; empty tables give no
findings; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.llm.tables import as_documents, read
from msgsieve.llm.words import Words, blocks, release_memory, sequence_hashes, text_bytes, valid_starts
from msgsieve.session import cut_lineage

SHINGLE = 5
MIN_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 23
BYTES = 8
BYTE_RADIUS = RADIUS // BYTES
BLOCK_BYTES = 8 << 20
SHINGLE_BASE = 0x5851F42D4C957F2D

_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which 64-bit numbers differ."""
    return np.bitwise_count(a ^ b)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``shingles[s : s + size]`` for each start; starts are sorted.

    Starts far from each other are taken apart, so memory follows the windows.
    """
    result = np.zeros(len(starts), dtype=np.uint64)
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > size) + 1):
        if not len(part):
            continue
        low, high = int(starts[part[0]]), int(starts[part[-1]]) + size
        raw = np.ascontiguousarray(shingles[low:high]).view(np.uint8).reshape(-1, 8)
        sums = np.zeros((high - low + 1, 64), dtype=np.int32)
        np.cumsum(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, out=sums[1:], dtype=np.int32)
        at = starts[part] - low
        ones = 2 * (sums[at + size] - sums[at]) >= size
        result[part] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


class Items:
    """The searched form of one block of items, grouped by number of words."""

    def __init__(self, ids: list, texts: list):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words = Words(data, offsets, lower=True, plain=True)
        hashes, first = words.hashes(), words.first
        self.by_size: dict[int, dict] = {}
        postings: dict[int, set] = {}
        for i, item in enumerate(ids):
            size = int(first[i + 1] - first[i])
            if size < MIN_WORDS:
                continue
            shingles = sequence_hashes(hashes[first[i] : first[i + 1]], SHINGLE, SHINGLE_BASE)
            group = self.by_size.setdefault(size, {"ids": [], "prints": [], "shingles": []})
            group["ids"].append(item)
            group["prints"].append(fingerprints(shingles, np.zeros(1, np.int64), len(shingles))[0])
            group["shingles"].append(np.unique(shingles, return_counts=True))
            for s in shingles.tolist():
                postings.setdefault(s, set()).add(size)
        for group in self.by_size.values():
            group["prints"] = np.array(group["prints"], dtype=np.uint64)
            # near[b, v, i]: byte b of item i is within BYTE_RADIUS bits of v
            own = group["prints"].view(np.uint8).reshape(-1, BYTES)
            group["near"] = _BITS[np.arange(256)[None, :, None] ^ own.T[:, None, :]] <= BYTE_RADIUS
        self.known = np.array(sorted(postings), dtype=np.uint64)
        self.sizes = [sorted(postings[s]) for s in self.known.tolist()]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles occur in an item."""
        if not len(self.known):
            return np.zeros(len(shingles), dtype=bool)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return self.known[at] == shingles

    def search(self, shingles: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
        """(item, first word, end word, similarity) for one document.

        ``places``: where ``shingles`` occur in an item.
        """
        by_size: dict[int, list[int]] = {}
        for place, at in zip(places.tolist(), np.searchsorted(self.known, shingles[places]).tolist()):
            for size in self.sizes[at]:
                by_size.setdefault(size, []).append(place)
        for size, found in by_size.items():
            group, width = self.by_size[size], size - SHINGLE + 1
            width = min(width, len(shingles))
            reach = np.array(found)[:, None] - np.arange(width)[None, :]
            starts = np.unique(reach[(reach >= 0) & (reach <= len(shingles) - width)])
            prints = fingerprints(shingles, starts, width)
            byte = prints.view(np.uint8).reshape(-1, BYTES)
            near = np.zeros((len(starts), len(group["ids"])), dtype=bool)
            for b in range(BYTES):
                near |= group["near"][b][byte[:, b]]
            windows, items = np.nonzero(near)
            close = distance(prints[windows], group["prints"][items]) <= RADIUS
            best: dict[int, tuple[float, int]] = {}
            for w, i in zip(windows[close].tolist(), items[close].tolist()):
                similarity = weighted_jaccard(group["shingles"][i], shingles[starts[w] : starts[w] + width])
                if similarity >= MIN_SIMILARITY and similarity > best.get(i, (0.0, 0))[0]:
                    best[i] = (similarity, int(starts[w]))
            for i, (similarity, start) in best.items():
                yield group["ids"][i], start, start + width + SHINGLE - 1, similarity


def weighted_jaccard(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
    window = np.sort(window)
    here = np.searchsorted(window, item[0], "right") - np.searchsorted(window, item[0], "left")
    common = int(np.minimum(here, item[1]).sum())
    return common / (int(item[1].sum()) + len(window) - common)


FOUND = "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, similarity double"


def _search(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """Findings of the block of items that was broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for low, high in blocks(offsets):
                words = Words(data, offsets[low : high + 1], lower=True, plain=True)
                shingles = sequence_hashes(words.hashes(), SHINGLE, SHINGLE_BASE)
                whole = valid_starts(words.first, SHINGLE, len(shingles))
                hits = np.flatnonzero(index.hits(shingles) & whole)
                docs_hit = np.searchsorted(words.first, hits, side="right") - 1
                for r in np.unique(docs_hit).tolist():
                    begin, end = int(words.first[r]), int(words.first[r + 1]) - SHINGLE + 1
                    name = batch.column(0)[low + r].as_py()
                    rows += [(name, *x) for x in index.search(shingles[begin:end], hits[docs_hit == r] - begin)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                names = ["doc_id", "item_id", "first_word", "end_word", "similarity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(search, FOUND)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first_word, end_word, similarity."""
    known = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES
    found = None
    for part in range(count):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == part).collect()  # one block
        sent = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in own], [r["text"] for r in own]))
        rows = cut_lineage(_search(docs, sent), "found")
        sent.destroy()
        found = rows if found is None else found.unionByName(rows)
    return found


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id of every row, with the items found in it and the best similarity."""
    found = find(docs, benchmark).groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    joined = docs.select(F.col("doc_id").cast("bigint")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
                         F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark passage."""
    docs = as_documents(docs)
    # written, so that the size of the findings is known before texts are shuffled for the join
    found = cut_lineage(
        find(docs, read(spark, folder, "benchmark")).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def op3_simhash_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = marked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"),
                        F.size("item_ids").cast("bigint").alias("n_items"), F.array_join("item_ids", ",").alias("item_ids"),
                        F.round("similarity", 6).alias("similarity"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[0-9a-z\x{80}-\x{10FFFF}]+')"
)
# All windows that share a shingle with an item, compared exactly.
SQL = rf"""
WITH items AS (
  SELECT item_id, w, len(w) - {SHINGLE - 1} AS width FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) >= {MIN_WORDS}
), of_items AS (
  SELECT item_id, width, s, count(*) AS n
  FROM (SELECT item_id, width, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM items, unnest(range(1, width + 1)) AS t(i))
  GROUP BY ALL
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), of_docs AS (
  SELECT doc_id, len(w) - {SHINGLE - 1} AS total, i AS place, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM docs, unnest(range(1, len(w) - {SHINGLE - 2})) AS t(i)
), hits AS (
  SELECT doc_id, item_id, place, s, n, width, least(width, total) AS size, total - least(width, total) + 1 AS last
  FROM of_docs JOIN of_items USING (s)
), starts AS (
  SELECT DISTINCT doc_id, item_id, place - k AS start FROM hits, unnest(range(0, size)) AS t(k)
  WHERE place - k BETWEEN 1 AND last
), matched AS (
  SELECT doc_id, item_id, start, any_value(width) AS width, any_value(size) AS size, s, least(count(*), any_value(n)) AS c
  FROM starts JOIN hits USING (doc_id, item_id) WHERE place BETWEEN start AND start + size - 1 GROUP BY doc_id, item_id, start, s
), compared AS (
  SELECT doc_id, item_id, sum(c) / (any_value(width) + any_value(size) - sum(c)) AS similarity
  FROM matched GROUP BY doc_id, item_id, start
), found AS (
  SELECT doc_id, item_id, max(similarity) AS similarity FROM compared GROUP BY ALL HAVING max(similarity) >= {MIN_SIMILARITY}
), marked AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids, max(similarity) AS best
  FROM found GROUP BY doc_id
)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(ids, '') AS item_ids,
  round(coalesce(best, 0)::DOUBLE, 6) AS similarity
FROM documents LEFT JOIN marked USING (doc_id)
"""
