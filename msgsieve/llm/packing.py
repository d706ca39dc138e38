"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

1. Texts become token ids in Arrow batches; each document ends with an end id, and
   only documents longer than a sequence are cut.
2. Pieces are counted by length: at most ``size`` rows, whatever the corpus.
3. ``minimum_slack`` fills one bin after another from these counts.  Each bin starts
   with the longest length left; a subset-sum over the lengths that still fit, held
   as bits of one number, finds the fullest feasible combination, which is removed.
   The same combination is removed as often as the counts allow, and each time at
   least one length runs out, so there are at most ``size`` different combinations.
4. Pieces of a length are numbered, and a number belongs to a combination, a bin and a
   place in it.  Numbers come from totals of hashed groups, so a length that a third
   of all pieces have is spread like any other.

Cases: a null text is an empty one, which is one piece holding only the end id;
repeated rows (equal ``doc_id`` too) are packed each for itself; a null ``doc_id`` is
a value like any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgsieve.llm.tables import read
from msgsieve.llm.words import blocks, release_memory, text_bytes
from msgsieve.session import cut_lineage

SIZE = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 250_000  # of one worker, about 50 MB; frequent words come early and stay
BLOCK = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,!?;:")] = True

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of whole columns, encoding each different word once.

    This tokenizer ignores case, removes white space and lets no token cross it or the
    line between a letter and a full stop, so a text's ids are the ids of such parts;
    ``tests/llm`` compares both ways.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def learn(self, words: list[str], found: dict[str, bytes]) -> None:
        """Words of Latin letters are one token sequence each, ended by an end-of-word token."""
        letters = [w for w in words if w.isalpha() and max(w) < "\u0100"]
        if letters:
            (coded,) = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            raw, low = ids.tobytes(), 0
            for word, high in zip(letters, (4 * ends).tolist(), strict=True):
                found[word], low = raw[low:high], high
        others = [w for w in words if w not in found]
        for word, coded in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            found[word] = np.array(coded.ids, dtype="<u4").tobytes()

    def of(self, words: list[str]) -> list[bytes]:
        known, fresh = self.known, {}
        new = [w for w in words if w not in known]
        for low in range(0, len(new), 4096):
            self.learn(new[low : low + 4096], fresh)
        result = [known[w] if w in known else fresh[w] for w in words]
        known.update(itertools.islice(fresh.items(), max(CACHED_WORDS - len(known), 0)))
        return result

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and where each row's ids begin and end."""
        raw = data[int(offsets[0]) : int(offsets[-1])]
        offsets = offsets - offsets[0]
        if b"<|" not in raw.tobytes():  # special tokens are found before case is dropped
            raw = _LOWER[raw]
        raw = np.where(raw == 0x0A, np.uint8(0x20), raw)
        letter = (raw >= 0x61) & (raw <= 0x7A)
        cut = np.flatnonzero(letter[:-1] & _STOP[raw[1:]]) + 1
        texts = pa.LargeStringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets + np.searchsorted(cut, offsets)),
            pa.py_buffer(np.insert(raw, cut, 0x20)))
        parts = pc.split_pattern(texts, " ")
        coded = parts.values.dictionary_encode()
        each = self.of(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        sizes = np.array([len(x) // 4 for x in each], dtype=np.int64)
        flat = np.frombuffer(b"".join(each), dtype="<u4")
        begins = np.cumsum(sizes) - sizes
        count = sizes[index]
        ends = np.cumsum(count)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[index] - (ends - count), count)
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        return flat[where], bounds


_kept: dict[str, WordTokens] = {}


def _worker_tokens(path: str) -> WordTokens:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    if path not in _kept:
        _kept[path] = WordTokens(path)
    return _kept[path]


def tokenize(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece, with the ids themselves if asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for low, high in blocks(offsets, BLOCK):
                ids, bounds = tokens.encode(data, offsets[low : high + 1])
                rows = []
                for i in range(high - low):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), size)):
                        part = own[start : start + size]
                        row = (names[low + i], piece, start, len(part), zlib.crc32(part.tobytes()))
                        rows.append((*row, part.astype(np.int32)) if with_ids else row)
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, schema)


def fullest(counts: np.ndarray, size: int, longest: int) -> list[int]:
    """Lengths that fill a bin best together with one of length ``longest``.

    Bit ``s`` of ``reach`` says that chosen lengths can sum to ``s``.  Long lengths come
    first, so short ones stay for later bins; ``steps`` keeps the bits for the way back.
    """
    room = size - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        copies = min(int(counts[length]) - (length == longest), room // length)
        while copies > 0:
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            copies -= 1
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, [longest]
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


def minimum_slack(counts: np.ndarray, size: int) -> Iterator[tuple[list[int], int]]:
    """Combinations of lengths and how many bins each fills, until ``counts`` is used up."""
    counts = counts.copy()
    while counts.any():
        chosen = fullest(counts, size, int(np.flatnonzero(counts)[-1]))
        lengths, uses = np.unique(chosen, return_counts=True)
        bins = int((counts[lengths] // uses).min())
        counts[lengths] -= uses * bins
        yield sorted(chosen, reverse=True), bins


def _plan(spark: SparkSession, counted: list, size: int) -> DataFrame:
    """For each length, which numbers go to which bins: rows of lengths x combinations at most."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in counted:
        counts[row["length"]] = row["count"]
    used, next_bin, rows = np.zeros(size + 1, dtype=np.int64), 0, []
    for chosen, bins in minimum_slack(counts, size):
        offset = 0
        for length in sorted(set(chosen), reverse=True):
            copies = chosen.count(length)
            rows.append((length, int(used[length]), int(used[length]) + copies * bins, next_bin, copies, offset))
            used[length] += copies * bins
            offset += copies * length
        next_bin += bins
    return spark.createDataFrame(
        rows, "length bigint, low bigint, high bigint, first_bin bigint, copies bigint, first_offset bigint")


def numbered(pieces: DataFrame, key: list[str], groups: int) -> DataFrame:
    """``number``: 0, 1, ... among the pieces of the same length."""
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy(*key)
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(totals, ["length", "part"]).withColumn("number", F.col("before") + F.col("rank"))


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be a written table."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    total = sum(r["count"] for r in counted)
    # Enough groups that one holds some ten thousand pieces of a length at most.
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) + total // 16384
    plan = _plan(spark, counted, size)
    ranked = numbered(pieces, ["doc_id", "piece", "ids_crc32"], groups)
    inside = (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    joined = ranked.join(F.broadcast(plan.withColumnRenamed("length", "_l")), (F.col("length") == F.col("_l")) & inside)
    index: Column = F.col("number") - F.col("low")
    return joined.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(index / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(index, F.col("copies")) * F.col("length")).cast("bigint").alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] sequence_id and offset of every piece."""
    return place(cut_lineage(tokenize(docs, path, size, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences for training from ``pack(..., with_ids=True)``: ids, and each piece's place.

    A group is one sequence, so it never holds more than its tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"], x["length"], x["doc_id"])).alias("pieces"))


def pack_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: where every piece of every document goes."""
    return pack(docs, tokenizer_path())


def op5_minimum_slack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), tokenizer_path())
