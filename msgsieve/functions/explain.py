"""Keyword hits, signal reasons and the explanation of a decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from msgsieve import fixed_values as fixed


def _present(flags: Sequence[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in list order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(value)) for flag, value in flags]))


def keyword_hits(
    text: Column,
    label_id: Column,
    spam_keywords: Sequence[str] = tuple(fixed.SPAM_KEYWORDS),
    phishing_keywords: Sequence[str] = tuple(fixed.PHISHING_KEYWORDS),
) -> Column:
    """Keywords of the label's list contained in the text, ignoring case."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def hits(words: Sequence[str]) -> Column:
        return _present([(F.contains(lowered, F.lit(word.lower())), word) for word in words])

    return (
        F.when(label_id == 1, hits(spam_keywords))
        .when(label_id == 2, hits(phishing_keywords))
        .otherwise(F.array().cast("array<string>"))
    )


def signal_reasons(url_count: Column, phone_count: Column, exclamation_count: Column) -> Column:
    """Reasons taken from the signals, in a fixed order."""
    return _present(
        [
            (url_count > 0, fixed.REASON_URL),
            (phone_count > 0, fixed.REASON_PHONE),
            (exclamation_count > 2, fixed.REASON_EXCLAMATION),
        ]
    )


def explanation(label_id: Column, keywords: Column, reasons: Column) -> Column:
    """Readable reason for the label: first five keywords, then the reasons."""

    def sentence(prefix: str, default: str) -> Column:
        found = F.when(
            F.size(keywords) > 0,
            F.concat(F.lit(prefix), F.array_join(F.slice(keywords, 1, 5), ", ")),
        )
        parts = F.concat(F.array_compact(F.array(found)), reasons)
        return F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(F.lit(default))

    return (
        F.when(label_id == 0, F.lit(fixed.EXPLAIN_HAM))
        .when(label_id == 1, sentence(fixed.EXPLAIN_SPAM_PREFIX, fixed.EXPLAIN_SPAM_DEFAULT))
        .otherwise(sentence(fixed.EXPLAIN_PHISHING_PREFIX, fixed.EXPLAIN_PHISHING_DEFAULT))
    )


def risk_words(keywords: Column, reasons: Column, limit: int = 8) -> Column:
    """Union of keywords and reasons, first seen first, at most ``limit``.

    The limit is part of the report, not a cut of the data.
    """
    return F.slice(F.array_union(keywords, reasons), 1, limit)
