"""Document quality by weak supervision instead of rules that all must pass.

Each rule looks at one trait of a text and votes good (1), bad (0) or abstains
(null).  Votes are counted per pattern - at most 3 ** rules patterns, whatever the
corpus - and expectation-maximisation on these counts estimates how often each rule
votes good, bad or not at all on good and on bad documents, and the share of good
documents.  A document's posterior probability of being good follows from its votes.
Documents that fail the two base rules are never kept.

Everything that touches texts is a built-in expression.  Word windows are compared
by hash first; only texts in which a hash repeats sort their windows to find exactly
which words repeat.

Cases: a null or blank text has no words, so all counts are 0 and the base rules
reject it; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.  Rules abstain where their trait is not defined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.functions.evaluation import bind, computed_once
from msgsieve.llm.tables import as_documents, read
from msgsieve.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MIN_POSTERIOR = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_upper", "n_letters", "n_exclaimed", "n_same_as_last"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def _indices(first: int, last: Column) -> Column:
    """first..last, empty where last < first."""
    return F.when(last < first, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(first), last))


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words found twice or more."""

    def exact(starts: Column) -> Column:
        rows = F.array_sort(F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, size), " ").alias("w"), i.alias("p"))))

        def flagged(found: Column) -> Column:
            def position(i: Column) -> Column:
                here = F.get(found, i)
                twin = (here["w"] == F.get(found, i - 1)["w"]) | (here["w"] == F.get(found, i + 1)["w"])
                return F.when(twin, here["p"])

            return F.array_sort(F.array_compact(F.transform(_indices(0, F.size(found) - 1), position)))

        def covered(at: Column) -> Column:
            steps = F.transform(_indices(1, F.size(at) - 1),
                                lambda j: F.least(F.lit(size), F.get(at, j) - F.get(at, j - 1)))
            return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(steps, F.lit(size), lambda a, x: a + x))

        return bind(bind(rows, flagged), covered)

    def counted(starts: Column) -> Column:
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)]))
        unique = bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(unique, 0).otherwise(exact(starts))

    return bind(_indices(0, F.size(tokens) - size), counted)


def text_counts(text: Column) -> Column:
    """A struct of the counts that the base rules and the voting rules use."""
    body = F.coalesce(text, F.lit(""))

    def length_without(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    def with_words(tokens: Column) -> Column:
        def with_lines(lines: Column) -> Column:
            return F.struct(
                F.size(tokens).cast("bigint").alias("n_words"),
                F.length(F.array_join(tokens, "")).cast("bigint").alias("word_chars"),
                length_without(SYMBOLS).cast("bigint").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
                repeated_words(tokens).cast("bigint").alias("n_repeat_words"),
                F.size(lines).cast("bigint").alias("n_lines"),
                F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct"),
                length_without(r"\p{Lu}+").cast("bigint").alias("n_upper"),
                length_without(r"\p{L}+").cast("bigint").alias("n_letters"),
                length_without("!+").cast("bigint").alias("n_exclaimed"),
                F.aggregate(_indices(1, F.size(tokens) - 1), F.lit(0), lambda a, i: a + F.when(
                    F.get(tokens, i) == F.get(tokens, i - 1), 1).otherwise(0)).cast("bigint").alias("n_same_as_last"),
            )

        with_a_word = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return bind(with_a_word, with_lines)

    return bind(words(body), with_words)


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def bad_from(value: Column, least: float) -> Column:
    """0 from ``least`` on, else no vote: that one fault is absent says little."""
    return F.when(value >= least, 0).cast("int")


def rules() -> dict[str, Column]:
    """Voting expressions over the columns in COUNTS."""
    letters, mean_length = ratio("n_letters", "word_chars"), ratio("word_chars", "n_words")
    return {
        "letters": F.when(letters >= 0.93, 1).when(letters < 0.88, 0).cast("int"),
        "length": F.when(F.col("n_words") >= 20, 1).when(F.col("n_words") < MIN_WORDS, 0).cast("int"),
        "word_length": F.when(mean_length.between(3, 10), 1).when((mean_length < 2) | (mean_length > 14), 0).cast("int"),
        "symbols": bad_from(ratio("n_symbols", "n_words"), 0.10),
        "capitals": bad_from(ratio("n_upper", "n_letters"), 0.40),
        "exclaimed": bad_from(ratio("n_exclaimed", "n_words"), 0.20),
        "dup_lines": bad_from(ratio("n_dup_lines", "n_lines"), 0.40),
        "repeated_windows": bad_from(ratio("n_repeat_words", "n_words"), 0.20),
        "word_runs": bad_from(ratio("n_same_as_last", "n_words"), 0.20),
    }


class VoteModel:
    """Shares of (good vote, bad vote, no vote) by rule and class, and the prior of good.

    ``shares[c][r][v]`` for class c (0 bad, 1 good), rule r and vote v.
    """

    # What is believed before seeing votes, worth PRIOR_WEIGHT of the documents:
    # good documents seldom get a bad vote, bad ones get one from some of the rules.
    GOOD = {1: 0.60, 0: 0.01, None: 0.39}
    BAD = {1: 0.30, 0: 0.30, None: 0.40}
    PRIOR_GOOD = 0.8
    PRIOR_WEIGHT = 0.05

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.prior = self.PRIOR_GOOD
        self.shares = [[dict(self.BAD) for _ in names], [dict(self.GOOD) for _ in names]]

    def log_odds(self, votes: Sequence[int | None]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(
            math.log(self.shares[1][r][v] / self.shares[0][r][v]) for r, v in enumerate(votes))

    def fit(self, counted: Sequence[tuple[tuple[int | None, ...], int]], rounds: int = 200, tolerance: float = 1e-9):
        """EM over (votes, count) pairs; ends when no share moves by more than ``tolerance``."""
        total = sum(n for _, n in counted)
        if not total:
            return self
        belief = self.PRIOR_WEIGHT * total
        for _ in range(rounds):
            weight = [0.0, 0.0]
            sums = [[dict.fromkeys(self.GOOD, 0.0) for _ in self.names] for _ in range(2)]
            for votes, n in counted:
                good = 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(votes)))))
                for c, share in ((0, 1 - good), (1, good)):
                    weight[c] += n * share
                    for r, v in enumerate(votes):
                        sums[c][r][v] += n * share
            moved = 0.0
            for c, prior in ((0, self.BAD), (1, self.GOOD)):
                for r in range(len(self.names)):
                    for v in prior:
                        new = (sums[c][r][v] + belief * prior[v]) / (weight[c] + belief)
                        moved = max(moved, abs(new - self.shares[c][r][v]))
                        self.shares[c][r][v] = new
            self.prior = (weight[1] + belief * self.PRIOR_GOOD) / (total + belief)
            if moved < tolerance:
                break
        return self

    def accuracies(self) -> dict[str, float]:
        """Probability that a vote of the rule is right, given that it votes."""
        result = {}
        for r, name in enumerate(self.names):
            right = self.prior * self.shares[1][r][1] + (1 - self.prior) * self.shares[0][r][0]
            wrong = self.prior * self.shares[1][r][0] + (1 - self.prior) * self.shares[0][r][1]
            result[name] = right / (right + wrong)
        return result

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, name in enumerate(self.names):
            one, zero, none = (math.log(self.shares[1][r][v] / self.shares[0][r][v]) for v in (1, 0, None))
            odds = odds + F.when(F.col(name).isNull(), none).when(F.col(name) == 1, one).otherwise(zero)
        return 1 / (1 + F.exp(-odds))


def with_votes(docs: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Carried columns, counts and one ``vote_<rule>`` column per rule, written once."""
    counted = computed_once(docs.select(*carried, F.col("text").alias("_body")), {"_c": text_counts(F.col("_body"))})
    counted = counted.select(*carried, *[F.col("_c")[n].alias(n) for n in COUNTS])
    votes = [v.alias(f"vote_{name}") for name, v in rules().items()]
    return cut_lineage(counted.select(*carried, *COUNTS, *votes), "votes")


def judge(docs: DataFrame, carried: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, VoteModel]:
    """Carried columns, counts, votes, ``posterior``, ``base_failed`` and ``kept``; and the fitted model.

    ``carried`` must not contain the names that are added.
    """
    voted = with_votes(docs, carried)
    names = [f"vote_{name}" for name in rules()]
    patterns = voted.groupBy(*names).count().collect()  # 3 ** rules rows at most
    counted = sorted(((tuple(r[n] for n in names), r["count"]) for r in patterns), key=repr)
    model = VoteModel(names).fit(counted)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = voted.withColumn("posterior", model.posterior()).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR)), model


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that the rules accept."""
    boxed = docs.select("text", F.struct(*as_documents(docs).columns).alias("_document"))
    judged, _ = judge(boxed, ["_document"])
    return judged.where("kept").select("_document.*")


def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = judge(read(spark, folder, "documents"))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
