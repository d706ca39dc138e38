"""Alignment of the token ids of two tokenizers on every document.

A is a byte-level BPE and reads a space and the text; B is a piece model with byte fallback
that puts the space there itself, so the bytes of both token sequences are the same.

1. Full tokenisation of whole texts by both libraries.  No token of either crosses the line
   between a character that is not white space and a space, so the stretches between such
   lines are encoded one by one, those seen before (``KEPT_WINDOWS`` in a worker) not again.
   A document whose bytes do not come out equal (a model may normalise) has no tokens.
2. Anchors: byte offsets where a token of A and a token of B both begin with a space, that
   is, where both sequences have ended a token before a space-marked one.  Each line is
   verified to be one: the ids of every stretch have exactly its bytes in both vocabularies.
   Anchors split a document into windows of token ids, mostly single words.
3. Within a window, offsets where tokens of both end cut it into groups, and all pairs of an
   A and a B token of a group are linked.  A window's alignment depends on its ids alone, so
   it is memoised by them; a worker keeps the first ``KEPT_WINDOWS``, or as many as have ``KEPT_IDS``
   ids and links together, and aligns others once a block of texts.
4. Counts: a task closes a chunk when its documents hold ``CHUNK_PAIRS`` different id pairs
   together.  A chunk is one row: its documents, its id pairs, and how many of its documents
   hold each.  Only the last two are exploded: a pair that every document holds counts once
   a chunk, not once a document.  Summed counts return to the chunks in the order of their
   pairs, and each document adds up its own.

Nothing is broadcast or collected, and a group is one chunk's own list of pairs, gathered by
stretches of ``GATHERED`` places.  Chunks are large rows, so the files hold them in row groups of
``CHUNKS_A_GROUP``: writers keep one group in memory, and readers unpack one at a time.

Cases: null and empty texts, and those of unequal bytes, have no tokens: zeros and an empty
``groups_sha256``; repeated rows (equal ``doc_id`` too) are documents each; a null ``doc_id``
stays null; special tokens' strings in a text are plain text; a text of any length is one
document of one chunk; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.llm.tables import read
from msgsieve.llm.words import blocks, release_memory, text_bytes
from msgsieve.session import cut_lineage

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_PAIRS = 300_000
KEPT_WINDOWS = 150_000
KEPT_IDS = 2_000_000
GATHERED = 4_096
CHUNKS_A_GROUP = 4
FEW_LINKS = 64
BLOCK = 1 << 20
SPACE_MARK = "▁"
AFTER_BLANK = re.compile(r"\s ")
LINE = re.compile(r"(?<=\S)(?= )")  # nothing crosses it
LATIN_END = "\u0250"
# Fixed value: how a byte-level vocabulary of this kind cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Ids = tuple[int, ...]
Window = tuple[Ids, Ids]
Aligned = tuple[int, int, str, int, list[int], dict[int, int]]

DOCUMENT = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))])
CHUNKS = (
    "chunk bigint, documents array<struct<doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, at array<int>, links array<bigint>>>, pairs array<bigint>, held array<int>")


def byte_of_letter() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for.

    Fixed values: visible Latin-1 characters stand for themselves, the other bytes in order for U+0100 and on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Bytes, lengths and space marks of a vocabulary's tokens."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.size = [len(r) for r in raw]
        self.length = np.array(self.size, dtype=np.int64)
        self.name_length = np.array([len(str(i)) for i in range(len(raw))], dtype=np.int64)
        self._names: dict[str, np.ndarray] = {}
        self.spaced = np.array([r.startswith(b" ") for r in raw], dtype=bool)

    def names(self, mark: str) -> np.ndarray:
        """Decimal ids with a mark after them."""
        if mark not in self._names:
            self._names[mark] = np.array([f"{i}{mark}" for i in range(len(self.raw))], dtype=object)
        return self._names[mark]

    def join(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])


class Aligner:
    """Both tokenizers and the memoised windows of one Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer_a = Tokenizer.from_file(path_a)
        self.tokenizer_a.encode_special_tokens = True
        self.tokenizer_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_of_letter()
        special = set(self.tokenizer_a.get_added_tokens_decoder())
        names = {i: name for name, i in self.tokenizer_a.get_vocab().items()}
        self.a = Tokens([
            names[i].encode() if i in special else bytes(letters[c] for c in names.get(i, ""))
            for i in range(max(names) + 1)])
        self.latin_a = tiktoken.Encoding(
            path_a, pat_str=PATTERN, special_tokens={}, mergeable_ranks={r: i for i, r in enumerate(self.a.raw) if r and i not in special})
        piece, b = self.tokenizer_b.id_to_piece, self.tokenizer_b
        self.b = Tokens([
            bytes([int(piece(i)[1:-1], 16)]) if b.is_byte(i) else piece(i).replace(SPACE_MARK, " ").encode()
            for i in range(b.get_piece_size())])
        self.stretches: dict[str, int] = {}  # numbers of windows by text, None where bytes are not equal
        self.recent: list[str] = []  # those that are not yet known to be kept
        self.unequal: list[str] = []
        self.numbers: dict[Window, int] = {}
        self.known: list[Aligned] = []
        self.weighed = self.weight = 0  # the first windows, and ids and links of these

    def encode_a(self, stretches: list[str]) -> list[Ids | None]:
        """Ids of A; None where their bytes are not those of the stretch.

        For Latin letters a second implementation of A's vocabulary is faster, and takes the
        stretches as one text.  Its pattern may know other classes of newer characters, so
        other stretches go to A's own library, as do those that end in white space.
        """
        found: list = [None] * len(stretches)
        latin = [i for i, s in enumerate(stretches) if max(s) < LATIN_END and not s[-1].isspace()]
        if latin:
            raw = [stretches[i].encode() for i in latin]
            ids = self.latin_a.encode_ordinary(b"".join(raw).decode())
            ends = np.cumsum(self.a.length[ids])
            wanted = np.cumsum([len(r) for r in raw])
            cuts = np.searchsorted(ends, wanted) + 1
            if ends[-1] == wanted[-1] and (ends[cuts - 1] == wanted).all() and self.a.join(ids) == b"".join(raw):
                cuts = cuts.tolist()
                for i, low, high in zip(latin, [0, *cuts], cuts):
                    found[i] = tuple(ids[low:high])
        others = [i for i, ids in enumerate(found) if ids is None]
        if others:
            coded = self.tokenizer_a.encode_batch_fast([stretches[i] for i in others], add_special_tokens=False)
            for i, c in zip(others, coded):
                found[i] = tuple(c.ids) if self.a.join(c.ids) == stretches[i].encode() else None
        return found

    def encode_b(self, stretches: list[str]) -> list[Ids | None]:
        """Ids of B, which puts the first space there itself; None where their bytes are not those of the stretch.

        B has no ids for an empty text, so the space alone that ends a text is named.
        """
        found = self.tokenizer_b.encode([s[1:] for s in stretches], num_threads=1)
        if " " in stretches:
            found[stretches.index(" ")] = [self.tokenizer_b.piece_to_id(SPACE_MARK)]  # stretches are distinct
        join = self.b.join
        if b"".join(map(join, found)) == "".join(stretches).encode() and all(found):
            sizes = [len(s) if s.isascii() else len(s.encode()) for s in stretches]
            if [sum(map(self.b.size.__getitem__, ids)) for ids in found] == sizes:
                return list(map(tuple, found))
        return [tuple(ids) if join(ids) == s.encode() else None for s, ids in zip(stretches, found)]

    def windows(self, texts: list[str]) -> list[list[int] | None]:
        """Numbers of the windows of texts, each after a space; None if their bytes do not come out equal."""
        cut = []
        for text in texts:
            text = " " + text
            cut.append(LINE.split(text) if AFTER_BLANK.search(text) else [" " + s for s in text[1:].split(" ")])
        known, numbers = self.stretches, self.numbers
        new = list({s for stretches in cut for s in stretches if s not in known})
        if new:
            fresh: list[Window] = []
            for stretch, a, b in zip(new, self.encode_a(new), self.encode_b(new)):
                if a is None or b is None:
                    known[stretch] = None
                    self.unequal.append(stretch)
                    continue
                self.recent.append(stretch)
                known[stretch] = number = numbers.setdefault((a, b), len(numbers))
                if number == len(self.known) + len(fresh):
                    fresh.append((a, b))
            if fresh:
                self.known += self.align(fresh)
        found = [[known[s] for s in stretches] for stretches in cut]
        return [None if None in windows else windows for windows in found]

    def forget(self) -> None:
        """Keep the windows that came first, frequent ones among them; only later ones are touched."""
        for stretch in self.unequal:
            del self.stretches[stretch]
        self.unequal = []
        full = False
        while self.weighed < min(len(self.known), KEPT_WINDOWS) and not full:
            n_a, n_b, _, _, pairs, large = self.known[self.weighed]
            own = n_a + n_b + len(pairs) + len(large)
            full = self.weight + own > KEPT_IDS
            if not full:
                self.weighed, self.weight = self.weighed + 1, self.weight + own
        kept = min(self.weighed, KEPT_WINDOWS)
        if full or len(self.known) >= KEPT_WINDOWS:
            del self.known[kept:]
            while len(self.numbers) > kept:
                self.numbers.popitem()  # the last that was added
            for stretch in self.recent:
                if self.stretches[stretch] >= kept:
                    del self.stretches[stretch]
            self.recent = []

    def align(self, windows: list[Window]) -> list[Aligned]:
        """Tokens of A and of B, groups as text, their number, and links' id pairs: one by one, or counted in large groups.

        All windows are laid end to end; both sides of each have the same bytes, so groups never cross them.
        """
        a, b = (np.fromiter(chain.from_iterable(w[i] for w in windows), np.int64) for i in (0, 1))
        last_a, last_b = (np.cumsum([len(w[i]) for w in windows]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b

        # a group is written as its tokens of A, each with a mark after it, then those of B
        text = np.empty(len(a) + len(b), dtype=object)
        width = np.empty(len(text), dtype=np.int64)
        for ids, tokens, place, more, end in (
            (a, self.a, np.arange(len(a)) + first_b[group_a], np.diff(group_a, append=-1) == 0, "|"),
            (b, self.b, np.arange(len(b)) + (first_a + size_a)[group_b], np.diff(group_b, append=-1) == 0, ";"),
        ):
            text[place] = np.where(more, tokens.names(",")[ids], tokens.names(end)[ids])
            width[place] = tokens.name_length[ids] + 1
        written = "".join(text.tolist())
        stops = np.cumsum(width)[last_a + last_b - 1].tolist()

        small = size_a * size_b <= FEW_LINKS
        times = np.where(small, size_b, 0)[group_a]
        linked_a = np.repeat(np.arange(len(a)), times)
        linked_b = np.arange(len(linked_a)) - np.repeat(np.cumsum(times) - times, times) + first_b[group_a[linked_a]]
        pairs = (a[linked_a] << 32 | b[linked_b]).tolist()
        bounds = np.cumsum(times)[last_a - 1].tolist()
        groups = np.searchsorted(shared, ends_a[last_a - 1]) + 1
        found = [
            (len(w[0]), len(w[1]), written[low : high - 1], n, pairs[begin:end], {})
            for w, low, high, n, begin, end in zip(
                windows, [0, *stops], stops, np.diff(groups, prepend=0).tolist(), [0, *bounds], bounds)]
        for g in np.flatnonzero(~small).tolist():
            counted = found[int(np.searchsorted(groups, g, side="right"))][5]
            times_b = Counter(b[first_b[g] : first_b[g] + size_b[g]].tolist()).items()
            for x, n in Counter(a[first_a[g] : first_a[g] + size_a[g]].tolist()).items():
                for y, m in times_b:
                    counted[x << 32 | y] = counted.get(x << 32 | y, 0) + n * m
        return found

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups' digest, different id pairs and the links of each, for a block of texts."""
        result = []
        for text, numbers in zip(texts, self.windows(texts)):
            if numbers is None or not text:
                result.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            n_a, n_b, groups, n_groups, pairs, large = zip(*map(self.known.__getitem__, numbers))
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            pairs, links = np.unique(np.fromiter(chain.from_iterable(pairs), np.int64), return_counts=True)
            counted: Counter[int] = Counter()
            for own in filter(None, large):
                counted.update(own)
            if counted:
                pairs, place = np.unique(np.concatenate([pairs, np.array(list(counted), np.int64)]), return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, place, np.concatenate([links, np.array(list(counted.values()), np.int64)]))
                links = total
            result.append((sum(n_a), sum(n_b), sum(n_groups), int(links.sum()), digest, pairs, links))
        self.forget()
        return result


_kept: dict[tuple[str, str], Aligner] = {}


def _worker_aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, so that later tasks find the windows of earlier ones."""
    if (path_a, path_b) not in _kept:
        _kept[path_a, path_b] = Aligner(path_a, path_b)
    return _kept[path_a, path_b]


class Chunk:
    """Documents of a task with their id pairs, each pair stored once."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.links, self.size = number, [], [], [], 0

    def add(self, doc_id: int | None, figures: tuple) -> None:
        *row, pairs, links = figures
        self.rows.append((doc_id, *row))
        self.pairs.append(pairs)
        self.links.append(links)
        self.size += len(pairs) + 16

    def batch(self) -> pa.RecordBatch:
        bounds = pa.array(np.cumsum([0, *map(len, self.pairs)]), pa.int32())
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        plain = [pa.array(column, field.type) for column, field in zip(zip(*self.rows), DOCUMENT)]
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v, k)) for v, k in (
            (at, pa.int32()), (np.concatenate(self.links), pa.int64()))]
        rows = pa.StructArray.from_arrays([*plain, *lists], fields=list(DOCUMENT))
        held = np.bincount(at, minlength=len(pairs))  # a document lists a pair once
        return pa.RecordBatch.from_arrays([
            pa.array([self.number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(self.rows)], pa.int32()), rows),
            pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int32())),
        ], ["chunk", "documents", "pairs", "held"])


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """One row a chunk of documents: see CHUNKS."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _worker_aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32  # unique in this stage, and equal when a task is repeated
        chunk = Chunk(number)
        gc.disable()  # windows hold no cycles, and each search for some would pass over all of them
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                _, offsets = text_bytes(texts)
                for low, high in blocks(offsets, BLOCK):
                    own = [t or "" for t in texts.slice(low, high - low).to_pylist()]
                    for doc_id, figures in zip(ids[low:high], aligner.documents(own)):
                        chunk.add(doc_id, figures)
                        if chunk.size >= chunk_pairs:
                            yield chunk.batch()
                            number += 1
                            chunk = Chunk(number)
            if chunk.rows:
                yield chunk.batch()
        finally:
            gc.enable()
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(chunks, CHUNKS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, id_a, id_b, n (documents that hold it linked) and best (the highest n of its id of A)."""
    held = chunks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "held")))
    counts = held.groupBy("pair").agg(F.sum("held").alias("n")).select(
        "pair", F.shiftright("pair", 32).alias("id_a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("id_b"), "n")
    counts = cut_lineage(counts, "pair-counts")
    highest = counts.groupBy("id_a").agg(F.max("n").alias("highest"))
    return counts.join(highest, "id_a").select("pair", "id_a", "id_b", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    in_groups = {"parquet.block.row.count.limit": CHUNKS_A_GROUP}
    chunks = cut_lineage(aligned_chunks(docs, path_a, path_b, chunk_pairs), "aligned", **in_groups)
    counts = cut_lineage(pair_counts(chunks), "best-pairs")
    places = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    stretch = F.floor(F.col("place") / GATHERED).alias("stretch")
    # a task keeps the lists of its first groups in memory, so groups of single values are small
    listed = places.join(counts.select("pair", "n", "best"), "pair").repartition("chunk").groupBy("chunk", stretch).agg(
        F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("found"))
    lists = F.sort_array(F.collect_list(F.struct("stretch", F.col("found.n").alias("n"), F.col("found.best").alias("best"))))
    counted = listed.groupBy("chunk").agg(lists.alias("found")).select(
        "chunk", F.flatten("found.n").alias("n"), F.flatten("found.best").alias("best"))
    # arrays are taken apart before the join: inside the sums each look-up must be by place alone
    joined = chunks.select("chunk", "documents").join(counted, "chunk", "left")

    def total(d, value):
        return F.aggregate(F.arrays_zip(d["at"], d["links"]), F.lit(0).cast("bigint"), lambda sum_, x: sum_ + value(x))

    scored = F.transform("documents", lambda d: F.struct(
        d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), d["n_groups"].alias("n_groups"),
        d["n_links"].alias("n_links"),
        total(d, lambda x: F.when(F.get("best", x["at"]), x["links"]).otherwise(0)).alias("n_best"),
        total(d, lambda x: F.get("n", x["at"]) * x["links"]).alias("count_sum"),
        d["groups_sha256"].alias("groups_sha256")))
    return joined.select(F.inline(scored))


def token_map(counts: DataFrame) -> DataFrame:
    """id_a and id_b: for each id of A the id of B linked to it in most documents, the smaller one of equals.

    To start an embedding table of one model from that of another, say.
    """
    first = F.min_by("id_b", F.struct(-F.col("n"), F.col("id_b")))
    return counts.where("best").groupBy("id_a").agg(first.alias("id_b"))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(read(spark, folder, "documents"), *tokenizer_paths())
