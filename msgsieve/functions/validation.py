"""Request rules as columns: the list of broken rules of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.text import is_blank


def broken(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition (true = broken) holds."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])
    )


def _sized_text(name: str, text: Column, limit: int) -> list[tuple[str, Column]]:
    """Presence and length, both on the text as it came in."""
    return [
        (f"{name}_missing", text.isNull()),
        (f"{name}_empty", F.length(text) < 1),
        (f"{name}_too_long", F.length(text) > limit),
    ]


def _user(user_id: Column | None) -> list[tuple[str, Column]]:
    return [] if user_id is None else [("user_id_too_long", F.length(user_id) > 100)]


def predict_rules(text: Column, user_id: Column | None = None, limit: int = 2000) -> Column:
    """Broken rules of a scoring request."""
    blank = (F.length(text) >= 1) & (F.length(text) <= limit) & is_blank(text)
    return broken([*_sized_text("text", text, limit), ("text_blank", blank), *_user(user_id)])


def feedback_rules(
    text: Column,
    predicted_label: Column,
    actual_label: Column,
    user_id: Column | None = None,
    limit: int = 2000,
) -> Column:
    """Broken rules of a feedback request; blank text is allowed there."""

    def label(name: str, value: Column) -> tuple[str, Column]:
        return (f"{name}_invalid", ~F.coalesce(value.isin(fixed.LABELS), F.lit(False)))

    return broken(
        [
            *_sized_text("text", text, limit),
            label("predicted_label", predicted_label),
            label("actual_label", actual_label),
            *_user(user_id),
        ]
    )


def chat_rules(
    message: Column,
    history: Column | None = None,
    user_id: Column | None = None,
    limit: int = 1000,
    history_limit: int = 4000,
) -> Column:
    """Broken rules of a chat request with its ``array<struct<role, content>>``."""
    blank = (F.length(message) >= 1) & (F.length(message) <= limit) & is_blank(message)
    rules = [*_sized_text("message", message, limit), ("message_blank", blank)]
    if history is not None:
        sized = F.forall(
            history,
            lambda turn: F.coalesce(
                turn["role"].isNotNull() & F.length(turn["content"]).between(1, history_limit),
                F.lit(False),
            ),
        )
        rules.append(("history_invalid", ~sized))
    return broken([*rules, *_user(user_id)])
