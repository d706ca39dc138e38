"""Toxicity by a lexicon that also catches misspelled terms, weighed by their context.

* The lexicon is a trie of terms: given ones, and words and stems that labelled toxic
  documents use far more than others, in different surroundings (so that copies of one
  text do not make its words terms).
* A word is looked up by running its Levenshtein automaton over the trie: one edit for
  terms of five letters on, two from nine on.  The automaton's states are bits of one
  number per edit count.  A stem matches words that begin with it; a stem of less than
  nine letters allows no edit, so terms that begin with it stand beside it in the trie.
* Terms are runs of letters, so the runs in each word between white space are looked up;
  where none matches, the whole word is, as a mark or digit may stand for a letter.
* Words that several labelled harmless documents use are not taken for misspellings.
* A hit between quotation marks counts as quoted; hits near each other and to a second
  person strengthen each other.  A logistic regression over these figures, fitted on a
  bounded sample of labelled rows outside the held-out fold (``MOST_ROWS``), gives the score.
* The lexicon learns words of ``LEAST_LETTERS`` letters or more, at most ``MOST_TERMS`` terms
  and as many stems, those that tell most; this bounds the trie that tasks share.

Each different word is looked up once per worker, and only if a part of it equals the
part of a term that the allowed edits must leave whole.

Cases: null and empty texts have no hits and get the score of harmless ones; without
labelled rows only the given terms count, with fixed weights; repeated rows get equal
scores; a null ``doc_id`` is not held out; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from msgsieve.llm.labelled import held_out, training_rows
from msgsieve.llm.tables import read
from msgsieve.llm.words import Words, blocks, text_bytes
from msgsieve.session import cut_lineage

MOST_ROWS = 20_000
MOST_TERMS = 5_000
LEAST_LETTERS = 3
GIVEN_TERMS = ("idiot", "moron", "stupid", "imbecile", "loser", "scumbag", "worthless", "pathetic", "disgusting")
ONE_EDIT, TWO_EDITS = 5, 9
STEM_LENGTHS = (4, 5, 6, 7)
STEM_WORDS = 3
MIN_SUPPORT, MIN_PURITY = 4, 0.8
NEAR = 8
MIN_SCORE = 0.5
FEATURES = ["weight", "misspelled", "quoted", "clustered", "addressed", "density"]
COMMON = 2
CACHED_WORDS = 500_000
BLOCK = 4 << 20

YOU = frozenset("you your yours ya du dich dein ihr euch tu toi vous ton ta usted tú te".split())
_QUOTE = re.compile("[\"“”„«»‘]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def edits(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class Lexicon:
    """A trie of weighted terms and stems, searched with Levenshtein automata."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless: set[str]):
        self.harmless, self.weights = harmless, {}
        self.root: dict = {}
        self.parts: dict[tuple[int, int], set[str]] = {}
        for kind, listed in (("term", terms), ("stem", stems)):
            for text, weight in listed.items():
                self.weights[kind, text] = weight
                node = self.root
                for letter in text:
                    node = node.setdefault(letter, {})
                node[kind] = text  # letters are single characters, so the names cannot clash
                self._add_parts(text, edits(text))
        self.shapes = list(self.parts)

    def _add_parts(self, text: str, k: int) -> None:
        """k edits leave one of k + 1 parts whole, moved by at most k places."""
        bounds = [len(text) * i // (k + 1) for i in range(k + 2)]
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            for move in range(-min(i, k), min(i, k) + 1):
                if low + move >= 0:
                    self.parts.setdefault((low + move, high + move), set()).add(text[low:high])

    def may_match(self, word: str) -> bool:
        return any(word[low:high] in self.parts[low, high] for low, high in self.shapes)

    def search(self, word: str) -> tuple[str, str, int] | None:
        """(kind, term, edits) of the nearest match, the heavier one among equals."""
        if not self.may_match(word):
            return None
        length, most = len(word), 2
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        full = (1 << (length + 1)) - 1
        start = [1]
        for _ in range(most):
            start.append((start[-1] | start[-1] << 1) & full)  # word letters that the term lacks
        found, stack = [], [(self.root, tuple(start))]
        while stack:
            node, states = stack.pop()
            for letter, below in node.items():
                if len(letter) > 1:
                    continue
                here, new = places.get(letter, 0), []
                for e in range(most + 1):
                    state = (states[e] & here) << 1
                    if e:
                        state |= states[e - 1] << 1 | states[e - 1] | new[-1] << 1
                    new.append(state & full)
                if not new[most]:
                    continue
                for kind in ("term", "stem"):
                    if kind in below:
                        text = below[kind]
                        wanted = 1 << length if kind == "term" else full
                        # a short stem with an edit is the beginning of too many words
                        most_edits = 0 if kind == "stem" and len(text) < TWO_EDITS else edits(text)
                        for e in range(most_edits + 1):
                            if new[e] & wanted:
                                found.append((e, -self.weights[kind, text], kind, text))
                                break
                stack.append((below, tuple(new)))
        if not found:
            return None
        e, _, kind, text = min(found)
        if e and word in self.harmless:
            return None
        return kind, text, e

    def vector(self, tokens: list[str], hits: list[tuple[int, str, str, int]]) -> np.ndarray:
        """The figures of one document from all its tokens and (place, kind, term, edits) of its hits."""
        exact = misspelled = quoted = clustered = addressed = 0.0
        before = None
        for place, kind, text, e in hits:
            low, high = max(0, place - NEAR), place + NEAR + 1
            left = sum(len(_QUOTE.findall(t)) for t in tokens[low:place])
            word = tokens[place]
            opened = bool(_QUOTE.match(word[:1])) or left % 2 == 1
            closed = bool(_QUOTE.search(word[1:])) or any(_QUOTE.search(t) for t in tokens[place + 1 : high])
            if opened and closed:
                quoted += 1
                continue
            if e:
                misspelled += self.weights[kind, text]
            else:
                exact += self.weights[kind, text]
            clustered += before is not None and place - before <= NEAR
            addressed += any(_EDGE.sub("", t) in YOU for t in tokens[low:high])
            before = place
        plain = len(hits) - quoted
        whole = exact + misspelled
        return np.array([math.log1p(whole), misspelled / whole if whole else 0.0, math.log1p(quoted),
                         math.log1p(clustered), math.log1p(addressed), math.log1p(100 * plain / max(len(tokens), 1))])


def letter_runs(text: str) -> list[str]:
    """The words that ``usage`` counts: runs of letters of a text in lower case."""
    return "".join(c if c.isalpha() else " " for c in text).split()


class Finder:
    """Looks up all words of blocks of texts, each different one once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def look_up(self, word: str) -> list[tuple[str, str, int]] | None:
        """The matches of the letter runs in a white-space word, else of the whole word."""
        word = _EDGE.sub("", word.lower())
        runs = [word] if word.isalpha() else letter_runs(word)
        found = [m for r in runs if len(r) >= LEAST_LETTERS and (m := self.lexicon.search(r)) is not None]
        if not found and runs != [word] and len(word) >= LEAST_LETTERS and (m := self.lexicon.search(word)) is not None:
            found.append(m)  # a mark or digit may stand for a letter
        return found or None

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of FEATURES per text of a block."""
        words = Words(data, offsets, lower=True)
        result = np.zeros((len(offsets) - 1, len(FEATURES)))
        if not len(words):
            return result
        length = words.end - words.start
        bounds = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(int(bounds[-1])) + np.repeat(words.start - bounds[:-1], length)
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(words.data[place])])
        coded = column.dictionary_encode()
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        matches, marked = [], np.zeros(len(coded.dictionary), dtype=bool)
        for i, raw in enumerate(coded.dictionary.to_pylist()):
            if raw not in self.known:
                self.known[raw] = self.look_up(raw.decode("utf-8", "replace"))
            matches.append(self.known[raw])
            marked[i] = matches[-1] is not None
        index = coded.indices.to_numpy()
        hits = np.flatnonzero(marked[index])
        rows = np.searchsorted(words.first, hits, side="right") - 1
        for r in np.unique(rows).tolist():
            low, high = int(words.first[r]), int(words.first[r + 1])
            tokens = [t.decode("utf-8", "replace").lower() for t in column.slice(low, high - low).to_pylist()]
            own = hits[rows == r].tolist()
            result[r] = self.lexicon.vector(tokens, [(h - low, *m) for h in own for m in matches[index[h]]])
        return result


def usage(sample: DataFrame) -> DataFrame:
    """word, toxic and harmless documents that use it, and 64 bits hit by its surroundings in toxic ones."""
    tokens = F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+", -1), "")
    places = sample.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), "label", tokens.alias("w")).select(
        "text_key", "label", "w", F.posexplode("w").alias("i", "word"))
    around = F.pmod(F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)), F.lit(64)).cast("int")
    used = places.where(F.length("word") >= LEAST_LETTERS).select(
        "text_key", "label", "word", F.call_function("shiftleft", F.lit(1).cast("bigint"), around).alias("bit"))
    by_text = used.groupBy("word", "text_key").agg(F.max("label").alias("label"), F.bit_or("bit").alias("bits"))
    return by_text.groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("harmless"),
        F.bit_or(F.when(F.col("label") == 1, F.col("bits")).otherwise(0)).alias("bits"))


def telling(counts: DataFrame, share: float, least: float) -> DataFrame:
    """Rows whose words speak for toxicity, with ``gain`` (log-likelihood ratio) and ``weight`` (log odds)."""
    n = F.col("toxic") + F.col("harmless")

    def term(part: Column, base: float) -> Column:
        return F.when(part > 0, part * F.log(part / (n * base))).otherwise(0.0)

    gain = term(F.col("toxic"), share) + term(F.col("harmless"), 1 - share)
    weight = F.log((F.col("toxic") + 0.5) / (F.col("harmless") + 0.5)) + math.log((1 - share) / share)
    surroundings = F.bit_count("bits")  # of 64; copies of a text share theirs
    varied = (surroundings >= MIN_SUPPORT) & (2 * surroundings >= F.least("toxic", F.lit(40)))
    return counts.where((F.col("toxic") >= MIN_PURITY * n) & varied).select(
        "*", gain.alias("gain"), F.least(weight, F.lit(8.0)).alias("weight")).where(F.col("gain") >= least)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms, stems and harmless look-alikes of a sample with ``text`` and ``label``."""
    given = dict.fromkeys(GIVEN_TERMS, 4.0)
    shares = sample.select(F.count("*"), F.sum("label")).first()
    share = (shares[1] or 0) / shares[0] if shares[0] else 0.0
    if not 0 < share < 1:
        return Lexicon(given, {}, set())
    words = cut_lineage(usage(sample), "usage")
    least = math.log(max(words.count(), 1)) + 2  # what the best of that many words reaches by chance, and more
    terms = telling(words, share, least).orderBy(F.desc("gain"), "word").limit(MOST_TERMS).collect()
    starts = words.where(F.length("word") >= min(STEM_LENGTHS)).select(
        "word", "toxic", "harmless", "bits",
        F.explode(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("stem")
    ).where("stem IS NOT NULL")
    grouped = starts.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"), F.bit_or("bits").alias("bits"),
        F.sum((F.col("toxic") >= 1).cast("int")).alias("words"), F.max("toxic").alias("most"))
    stems = telling(grouped.where((F.col("words") >= STEM_WORDS) & (F.col("most") < 0.6 * F.col("toxic"))),
                    share, least).orderBy(F.desc("gain"), "stem").limit(MOST_TERMS).collect()
    kept: dict[str, float] = {}
    for row in sorted(stems, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(row["stem"].startswith(s) for s in kept):
            kept[row["stem"]] = row["weight"]
    found = {r["word"]: r["weight"] for r in terms}  # also those that a stem covers: only terms match with edits
    lexicon = Lexicon(given | found, kept, set())
    return Lexicon(given | found, kept, look_alikes(words, lexicon))


def look_alikes(words: DataFrame, lexicon: Lexicon) -> set[str]:
    """Words of harmless documents that would pass for misspelled terms.

    A word of one document only is left in: from these the regression learns how far a
    misspelling can be trusted.
    """
    sent = words.sparkSession.sparkContext.broadcast(lexicon)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [(m := sent.value.search(w)) is not None and m[2] > 0 for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(fits, pa.bool_()))

    used = words.where((F.col("harmless") > F.col("toxic")) & (F.col("harmless") >= COMMON)).select("word")
    return {r["word"] for r in used.mapInArrow(match, "word string").collect()}


class Weights:
    """Logistic regression over FEATURES, fitted by Newton steps that are halved until the likelihood rises.

    A small penalty pulls towards what is believed before learning, so a figure that no
    labelled document has (quotations, say) keeps its believed weight.
    """

    PENALTY = 0.3
    MOST_STEPS = 200
    FLAT = 1e-7  # largest slope at the maximum, a labelled row
    BELIEVED = np.array([-3.5, 3.0, -0.5, 0.0, 0.3, 0.3, 0.3])

    def __init__(self):
        self.values = self.BELIEVED

    @staticmethod
    def _full(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), x])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Weights:
        """The maximum of the penalised likelihood; raises if it is not reached."""
        if not len(y) or y.min() == y.max():
            return self
        x, beta = self._full(x), self.BELIEVED.copy()

        def likelihood(b: np.ndarray) -> float:
            line = x @ b
            return float(y @ line - np.logaddexp(0, line).sum() - self.PENALTY / 2 * ((b - self.BELIEVED) ** 2).sum())

        reached = likelihood(beta)
        for _ in range(self.MOST_STEPS):
            p = np.exp(-np.logaddexp(0, -(x @ beta)))
            slope = x.T @ (y - p) - self.PENALTY * (beta - self.BELIEVED)
            if np.abs(slope).max() < self.FLAT * (1 + len(y)):
                self.values = beta
                return self
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + self.PENALTY * np.eye(x.shape[1]), slope)
            part = 1.0  # a whole step can pass the maximum by far where the curve is nearly flat
            while part > 1e-10 and (now := likelihood(beta + part * step)) < reached + 1e-4 * part * float(slope @ step):
                part /= 2
            beta, reached = beta + part * step, max(now, reached)
        raise RuntimeError(f"no maximum after {self.MOST_STEPS} steps: gradient {np.abs(slope).max():.3g}")

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._full(x) @ self.values, -30, 30)))


def vectors(docs: DataFrame, lexicon: Lexicon, carried: list[str]) -> DataFrame:
    """Carried columns and ``figures`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = docs.select(*carried).schema.add("figures", ArrayType(DoubleType()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in blocks(offsets, BLOCK):
                found = finder.vectors(data, offsets[low : high + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low) for c in carried] + [pa.array(list(found))],
                    [*carried, "figures"])

    return docs.select(*carried, "text").mapInArrow(find, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> tuple[Lexicon, Weights]:
    sample = cut_lineage(training_rows(docs, labels, label, most, ["doc_id", "text"]), "toxic-sample")
    lexicon = learn_lexicon(sample)
    rows = sorted(map(tuple, vectors(sample, lexicon, ["label"]).collect()))  # ``most`` documents
    x = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))
    return lexicon, Weights().fit(x, np.array([r[0] for r in rows], dtype=float))


def score(docs: DataFrame, lexicon: Lexicon, weights: Weights) -> DataFrame:
    """doc_id and score of every row."""
    found = vectors(docs.select(F.col("doc_id").cast("bigint"), "text"), lexicon, ["doc_id"])
    bias, *slopes = weights.values.tolist()
    odds = sum((F.get("figures", F.lit(i)) * s for i, s in enumerate(slopes)), F.lit(bias))
    return found.select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"))


def op8_levenshtein_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    scored = score(docs, *fit(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))
