"""Scoring job: requests in, decision records and logs out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.functions import text as tx
from msgsieve.functions import validation
from msgsieve.functions.evaluation import computed_once
from msgsieve.functions.replies import format_reply
from msgsieve.functions.text import strip
from msgsieve.operators import scoring
from msgsieve.operators.prepare import signal_values
from msgsieve.plans.train import RiskModel
from msgsieve.session import cut_lineage

# Adds ``proba`` to messages that have text_clean and signals.
Scorer = Callable[[DataFrame], DataFrame]


def check_requests(requests: DataFrame) -> DataFrame:
    """Add ``reasons`` (broken rules) and strip the text of good requests."""
    user = F.col("user_id") if "user_id" in requests.columns else None
    checked = requests.withColumn("reasons", validation.predict_rules(F.col("text"), user))
    return checked.withColumn("text", F.when(F.size("reasons") == 0, strip(F.col("text"))).otherwise(F.col("text")))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def with_signals(messages: DataFrame) -> DataFrame:
    """Cleaned text and signals of every message; blank ones stay in.

    Decisions filter on scores made from these, so they are computed once.
    """
    return computed_once(messages, {"text_clean": tx.process(F.col("text")), **signal_values()})


def classify_messages(messages: DataFrame, scorer: Scorer | RiskModel) -> DataFrame:
    """Signals, probabilities, model label and confidence of each message."""
    score = scorer.score if isinstance(scorer, RiskModel) else scorer
    return scoring.classify(score(with_signals(messages)))


def score_messages(
    messages: DataFrame,
    scorer: Scorer | RiskModel,
    responses: DataFrame | None = None,
    threshold: float = scoring.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Decision records of messages, with second opinions where there are any.

    With responses the scores are read twice, by the unsure and by the sure
    messages, so they are written once and the model runs once.
    """
    classified = classify_messages(messages, scorer)
    if responses is not None:
        classified = cut_lineage(classified, "classified")
    return scoring.decide(classified, responses, threshold)


def replies(records: DataFrame, *keep: str) -> DataFrame:
    """Reply texts for the risky messages only."""
    return records.where(F.col("label").isin("spam", "phishing")).select(
        *keep, reply_column().alias("reply")
    )


def reply_column() -> Column:
    return format_reply(
        F.col("label"),
        F.col("confidence"),
        F.col("explanation"),
        F.col("keywords"),
        F.col("llm_explanation"),
        F.col("label_th"),
        F.col("risk_level_th"),
    )
