"""Scoring of messages, second opinions and the final decision record.

A scored table has ``message_id``, ``text``, the signals and ``proba``
(``array<double>`` of ham, spam, phishing).  The same expressions serve batch
and stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions import explain as ex
from msgsieve.functions import labels as lb
from msgsieve.functions.evaluation import bind, computed_once
from msgsieve.functions.responses import parse_response, request_prompt
from msgsieve.functions.text import is_blank

DEFAULT_THRESHOLD = 0.80


def linear_probabilities(
    features: Mapping[str, Column], coefficients: Sequence[Mapping[str, float]], intercepts: Sequence[float]
) -> Column:
    """Multinomial logistic probabilities from named features."""
    logits = []
    for weights, intercept in zip(coefficients, intercepts):
        logit = F.lit(float(intercept))
        for name, weight in weights.items():
            logit = logit + features[name] * F.lit(float(weight))
        logits.append(logit)
    return lb.softmax(logits)


def classify(scored: DataFrame) -> DataFrame:
    """Add the model's label and confidence; blank messages are certain ham."""
    certain = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    proba = F.when(is_blank(F.col("text")), certain).otherwise(F.col("proba"))
    scored = computed_once(scored, {"blank": is_blank(F.col("text")), "proba": proba})
    return scored.withColumns({"ml_label_id": lb.argmax(F.col("proba")), "ml_confidence": F.array_max("proba")})


def needs_second_opinion(threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Strictly below the threshold; blank messages never ask."""
    return (F.col("ml_confidence") < threshold) & ~F.col("blank")


def second_opinion_requests(
    classified: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    system_prompt: str = fixed.SECOND_OPINION_PROMPT,
) -> DataFrame:
    """Prompts for the messages the model is unsure about."""
    return classified.where(needs_second_opinion(threshold)).select(
        "message_id",
        F.lit(system_prompt).alias("system_prompt"),
        request_prompt(F.col("text")).alias("user_prompt"),
        "ml_confidence",
    )


def parsed_responses(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Valid answers, one per message; of several the first in text order."""
    parsed = computed_once(responses.select("message_id", raw), {"p": parse_response(F.col(raw))}).where("p.parse_ok")
    best = parsed.groupBy("message_id").agg(F.min(F.struct("p.label", "p.confidence", "p.reason")).alias("second"))
    return best


def _record(decided: DataFrame, spam_keywords: Sequence[str], phishing_keywords: Sequence[str]) -> DataFrame:
    """The decision record; expects final_label_id, final_confidence, hybrid, second."""
    label = F.col("final_label_id")
    keywords = ex.keyword_hits(F.col("text"), label, spam_keywords, phishing_keywords)
    reasons = ex.signal_reasons(F.col("url_count"), F.col("phone_count"), F.col("exclamation_count"))
    words = bind(
        keywords,
        lambda hits: bind(
            reasons,
            lambda why: F.struct(
                ex.explanation(label, hits, why).alias("explanation"), ex.risk_words(hits, why).alias("keywords")
            ),
        ),
    )
    blank_words = F.struct(F.lit(fixed.EXPLAIN_BLANK).alias("explanation"), F.array().cast("array<string>").alias("keywords"))
    with_words = decided.withColumn("_words", F.when(F.col("blank"), blank_words).otherwise(words))
    proba = [lb.round4(F.get("proba", F.lit(k))) for k in range(len(fixed.LABELS))]
    record = {
        "label": lb.label_name(label),
        "label_th": lb.label_name_th(label),
        "label_id": label,
        "confidence": lb.round4(F.col("final_confidence")),
        "risk_level": lb.risk_level(label),
        "risk_level_th": lb.risk_level_th(label),
        "explanation": F.col("_words.explanation"),
        "keywords": F.col("_words.keywords"),
        "processing_time_ms": F.lit(None).cast("double"),
        "probabilities": F.struct(*[p.alias(n) for p, n in zip(proba, fixed.LABELS)]),
        "confidence_source": F.when(F.col("hybrid"), F.lit("hybrid")).otherwise(F.lit("ml")),
        "llm_explanation": F.when(F.col("hybrid"), F.col("second.reason")),
    }
    carried = [c for c in ("message_id", "user_id", "text", "created_at") if c in decided.columns]
    return with_words.select(*carried, *[value.alias(name) for name, value in record.items()])


SECOND_TYPE = "struct<label:string,confidence:double,reason:string>"


def decide(
    classified: DataFrame,
    responses: DataFrame | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    spam_keywords: Sequence[str] = tuple(fixed.SPAM_KEYWORDS),
    phishing_keywords: Sequence[str] = tuple(fixed.PHISHING_KEYWORDS),
) -> DataFrame:
    """Final record of each message from the model and, if given, the answers.

    Only messages below the threshold are joined; confident ones pass by the
    join without being shuffled.  Late answers are picked up by running this
    again: rows then change from ``ml`` to ``hybrid``.
    """
    no_answer = F.lit(None).cast(SECOND_TYPE).alias("second")
    if responses is None:
        joined = classified.select("*", no_answer)
    else:
        unsure = classified.where(needs_second_opinion(threshold))
        sure = classified.where(~needs_second_opinion(threshold))
        answers = parsed_responses(responses)
        joined = unsure.join(answers, "message_id", "left").unionByName(sure.select("*", no_answer))
    return decide_joined(joined, spam_keywords, phishing_keywords)


def decide_joined(
    joined: DataFrame,
    spam_keywords: Sequence[str] = tuple(fixed.SPAM_KEYWORDS),
    phishing_keywords: Sequence[str] = tuple(fixed.PHISHING_KEYWORDS),
) -> DataFrame:
    """Final record of classified messages with their answer, or null, in ``second``."""
    second_id = lb.label_id(F.col("second.label"))
    agree = second_id == F.col("ml_label_id")
    both = F.round((F.col("ml_confidence") + F.col("second.confidence")) / 2, 4)
    decided = joined.withColumns(
        {
            "hybrid": F.col("second").isNotNull(),
            "final_label_id": F.when(F.col("second").isNotNull() & ~agree, second_id).otherwise(F.col("ml_label_id")),
            "final_confidence": F.when(F.col("second").isNull(), F.col("ml_confidence"))
            .when(agree, both)
            .otherwise(F.round("second.confidence", 4)),
        }
    )
    return _record(decided, spam_keywords, phishing_keywords)
