"""Reply texts for risky messages and answers to frequent questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from msgsieve import fixed_values as fixed


def format_reply(
    label: Column,
    confidence: Column,
    explanation: Column,
    keywords: Column,
    second_reason: Column,
    label_th: Column,
    risk_level_th: Column,
) -> Column:
    """The reply for one scored message, lines joined by newlines."""
    # bround is half-to-even, as the percentage of the reply has always been
    percent = F.bround(confidence * 100, 0).cast("bigint").cast("string")
    fills = {"pct": percent, "label_th": label_th, "risk": risk_level_th}

    def fill(template: str) -> Column:
        text = F.lit(template)
        for name, value in fills.items():
            if "{" + name + "}" in template:
                text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    def lines(kind: str) -> Column:
        texts = fixed.REPLY_TEXTS[kind]
        has_reason = F.coalesce(second_reason, F.lit("")) != ""
        has_words = F.coalesce(F.size(keywords), F.lit(0)) > 0
        words = F.concat(F.lit(texts["keywords"]), F.array_join(keywords, ", "))
        parts = [
            fill(texts["header"]),
            F.lit(""),
            explanation,
            F.when(has_reason, F.lit("")),
            F.when(has_reason, second_reason),
            F.when(has_words, F.lit("")),
            F.when(has_words, words),
        ]
        if texts["advice"]:
            parts += [F.lit("")] + [F.lit(line) for line in texts["advice"]]
        return F.array_join(F.array_compact(F.array(*parts)), "\n")

    return (
        F.when(label == "spam", lines("spam"))
        .when(label == "phishing", lines("phishing"))
        .otherwise(lines("other"))
    )


def faq_topic(question: Column, keywords: Sequence[tuple[str, str]] = tuple(fixed.FAQ_KEYWORDS)) -> Column:
    """Topic of the first listed keyword that the question contains, else null."""
    lowered = F.lower(question)
    topics = [F.when(F.contains(lowered, F.lit(word)), F.lit(topic)) for word, topic in keywords]
    return F.coalesce(*topics)


def faq_answer(
    question: Column,
    keywords: Sequence[tuple[str, str]] = tuple(fixed.FAQ_KEYWORDS),
    answers: Mapping[str, str] | None = None,
) -> Column:
    """Answer to a question by its first listed keyword, else null."""
    answers = fixed.FAQ_ANSWERS if answers is None else answers
    lowered = F.lower(question)
    found = [
        F.when(F.contains(lowered, F.lit(word)), F.lit(answers[topic])) for word, topic in keywords
    ]
    return F.coalesce(*found)
