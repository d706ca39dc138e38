"""Document quality by a factorisation machine.

Features are hashed words (of unit length together), and the quantile-like step that each
structure statistic of the text falls into, with the length known as metadata among them.
The model has a weight and ``RANK`` factors per feature; the interaction of two features
is the product of their factors.  All pairs are summed in linear time by

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over f [(sum v_if x_i)^2 - sum v_if^2 x_i^2].

It is fitted by mini-batch AdaGrad on a bounded sample of labelled rows outside the
held-out fold (``MOST_ROWS`` rows of ``MOST_FEATURES`` features together) on the driver; its size is fixed, so it is sent to all
tasks, which score whole texts.

Cases: null and empty texts have structure features only and get a score like any other;
without labelled rows of both kinds the score is their share, or 0.5; repeated rows get
equal scores; a null ``doc_id`` is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.llm.labelled import held_out, training_rows
from msgsieve.llm.tables import read
from msgsieve.llm.words import Words, blocks, sequence_hashes, text_bytes, valid_starts
from msgsieve.session import cut_lineage

MOST_ROWS = 20_000
MOST_FEATURES = 16_000_000  # of eight bytes, of all sampled rows
WORD_SLOTS = 1 << 14
RANK = 8
UPDATES, BATCH, RATE, DECAY, SEED = 500, 256, 0.05, 1e-4, 11
MIN_SCORE = 0.3

_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, list(b"#*$%&|<>")] = True
_CLASS[1, 0x41:0x5B] = True  # capitals
_CLASS[2, 0x61:0x7B] = _CLASS[2, 0x80:] = True
_CLASS[3, list(b"!")] = True
_CLASS[4, 0x30:0x3A] = True
_CLASS[5, list(b".?,;:")] = True
# A statistic's feature is the number of steps that it reaches.
STEPS = {
    "symbols": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5],
    "capitals": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7],
    "letters": [0.5, 0.6, 0.7, 0.78, 0.84, 0.88, 0.92, 0.95, 0.97],
    "exclaimed": [0.005, 0.02, 0.05, 0.2, 0.5, 0.9],
    "digits": [0.002, 0.01, 0.03, 0.1, 0.3],
    "stops": [0.02, 0.05, 0.1, 0.2, 0.4],
    "word_length": [2, 3, 4, 5, 6, 7, 8, 10, 14],
    "different": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeated": [0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8],
    "runs": [0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8],
    "line_words": [2, 4, 8, 16, 32, 64, 128],
    "words": [1, 3, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120],
}
_BEGIN = WORD_SLOTS + np.cumsum([0] + [len(s) + 1 for s in STEPS.values()])
SLOTS = int(_BEGIN[-1])


def _per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[bounds])


def _different(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, value) order, and which of them are the first of their kind."""
    order = np.lexsort((values, rows))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(values[order]) != 0) | (np.diff(rows[order]) != 0)
    return order, new


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots and values of all rows of a block, and each row's bounds in them."""
    words = Words(data, offsets, lower=True)
    raw, bounds = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    count, rows, hashes = len(offsets) - 1, words.rows(), words.hashes()
    n_words = np.diff(words.first)
    n_chars = np.maximum(_sum_words(words), 1)
    classes = [_per_row(c[raw], bounds) for c in _CLASS]
    n_letters = np.maximum(classes[1] + classes[2], 1)
    order, new = _different(rows, hashes)
    n_different = np.bincount(rows[order][new], minlength=count)
    fives = sequence_hashes(hashes, 5, 0x6C8E9CF570932BD5)
    whole = valid_starts(words.first, 5, len(fives))
    five_rows, fives = rows[: len(fives)][whole], fives[whole]
    n_fives = np.bincount(five_rows, minlength=count)
    five_order, first = _different(five_rows, fives)
    n_five_kinds = np.bincount(five_rows[five_order][first], minlength=count)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    at_least_one = np.maximum(n_words, 1)
    statistics = {
        "symbols": classes[0] / at_least_one, "capitals": classes[1] / n_letters, "letters": n_letters / n_chars,
        "exclaimed": classes[3] / at_least_one, "digits": classes[4] / n_chars, "stops": classes[5] / at_least_one,
        "word_length": n_chars / at_least_one, "different": n_different / at_least_one,
        "repeated": 1 - n_five_kinds / np.maximum(n_fives, 1) * (n_fives > 0) - (n_fives == 0),
        "runs": np.bincount(rows[same], minlength=count) / at_least_one,
        "line_words": n_words / (_per_row(raw == 0x0A, bounds) + 1), "words": n_words,
    }
    steps = np.stack([begin + np.searchsorted(limits, statistics[name], side="right")
                      for begin, (name, limits) in zip(_BEGIN, STEPS.items())], axis=1)
    word_rows, slots = rows[order][new], (hashes[order][new] >> np.uint64(20)).astype(np.int64) % WORD_SLOTS
    all_rows = np.concatenate([np.repeat(np.arange(count), steps.shape[1]), word_rows])
    all_slots = np.concatenate([steps.ravel(), slots])
    values = np.concatenate([np.ones(steps.size), 1 / np.sqrt(np.maximum(n_different, 1))[word_rows]])
    by_row = np.argsort(all_rows, kind="stable")
    return (all_slots[by_row].astype(np.int32), values[by_row].astype(np.float32),
            np.searchsorted(all_rows[by_row], np.arange(count + 1)))


def _sum_words(words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return np.diff(total[words.first])


class Machine:
    """Bias, weights and factors, and how to fit and apply them."""

    def __init__(self):
        self.bias = 0.0
        self.weight = np.zeros(SLOTS, dtype=np.float64)
        self.factor = np.random.default_rng(SEED).normal(0, 0.02, (SLOTS, RANK))

    def raw(self, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear-time scores; also each feature's scaled factors and their sums by row."""
        scaled = self.factor[slots] * values[:, None]
        sums = np.add.reduceat(scaled, bounds[:-1], axis=0)  # no row is empty
        squares = np.add.reduceat((scaled**2).sum(axis=1), bounds[:-1])
        linear = np.add.reduceat(self.weight[slots] * values, bounds[:-1])
        return self.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, scaled, sums

    def score(self, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(slots, values, bounds)[0], -30, 30)))

    def fit(self, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Machine:
        if not len(labels):
            return self
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
        self.bias = float(np.log(share / (1 - share)))
        if labels.min() == labels.max():
            self.factor[:] = 0
            return self
        random = np.random.default_rng(SEED)
        seen = [np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6)]
        for _ in range(-(-UPDATES * BATCH // len(labels))):
            shuffled = random.permutation(len(labels))
            for low in range(0, len(labels), BATCH):
                rows = shuffled[low : low + BATCH]
                sizes = bounds[rows + 1] - bounds[rows]
                own = np.concatenate([[0], np.cumsum(sizes)])
                take = np.repeat(bounds[rows] - own[:-1], sizes) + np.arange(own[-1])
                s, x, owner = slots[take], values[take], np.repeat(np.arange(len(rows)), sizes)
                raw, scaled, sums = self.raw(s, x, own)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
                used, place = np.unique(s, return_inverse=True)
                pull = error[owner] * x
                slope = np.bincount(place, pull, len(used)) + DECAY * self.weight[used]
                part = pull[:, None] * (sums[owner] - scaled)
                slopes = np.stack([np.bincount(place, part[:, f], len(used)) for f in range(RANK)], axis=1)
                slopes += DECAY * self.factor[used]
                seen[0][used] += slope**2
                seen[1][used] += slopes**2
                self.weight[used] -= RATE * slope / np.sqrt(seen[0][used])
                self.factor[used] -= RATE * slopes / np.sqrt(seen[1][used])
                self.bias -= RATE * float(error.sum())
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS,
        most_features: int = MOST_FEATURES) -> Machine:
    """The machine for ``label``; only the hashed features of the sampled rows come to the driver.

    The sample ends before the row, in order of the ids' hashes, that would exceed ``most_features``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in blocks(offsets):
                slots, values, bounds = features(data, offsets[low : high + 1])
                cut = [slice(*b) for b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), batch.column("label").slice(low, high - low),
                    pa.array([slots[c].tobytes() for c in cut], pa.binary()),
                    pa.array([values[c].tobytes() for c in cut], pa.binary())], ["doc_id", "label", "slots", "values"])

    sample = training_rows(docs, labels, label, most, ["doc_id", "text"])
    encoded = cut_lineage(sample.select(F.col("doc_id").cast("bigint"), "text", "label").mapInArrow(
        encode, "doc_id bigint, label int, slots binary, values binary"), "quality-sample")
    place = F.xxhash64("doc_id")
    sizes = encoded.select(place, "doc_id", F.expr("octet_length(slots) div 4")).collect()  # ``most`` triples
    total = 0
    for row in sorted(map(tuple, sizes)):
        total += row[2]
        if total > most_features:
            encoded = encoded.where(place < row[0])
            break
    rows = sorted(encoded.collect(), key=lambda r: r["doc_id"])  # ``most_features`` features
    bounds = np.concatenate([[0], np.cumsum([len(r["slots"]) // 4 for r in rows])]).astype(np.int64)
    slots = np.frombuffer(b"".join(r["slots"] for r in rows), dtype=np.int32)
    values = np.frombuffer(b"".join(r["values"] for r in rows), dtype=np.float32)
    return Machine().fit(slots, values, bounds, np.array([r["label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS * (RANK + 1) numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in blocks(offsets):
                scores = sent.value.score(*features(data, offsets[low : high + 1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(apply, "doc_id bigint, score double")


def op9_factorization_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    scored = score(docs, fit(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))
