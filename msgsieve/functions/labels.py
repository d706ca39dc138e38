"""Label lookups, argmax, softmax and rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.evaluation import bind


def by_label_id(label_id: Column, values: Sequence[str]) -> Column:
    """The entry of ``values`` at a label id, null outside the range."""
    return F.get(F.array(*[F.lit(value) for value in values]), label_id.cast("int"))


def label_name(label_id: Column) -> Column:
    return by_label_id(label_id, fixed.LABELS)


def label_name_th(label_id: Column) -> Column:
    return by_label_id(label_id, fixed.LABELS_TH)


def risk_level(label_id: Column) -> Column:
    return by_label_id(label_id, fixed.RISK_LEVELS)


def risk_level_th(label_id: Column) -> Column:
    return by_label_id(label_id, fixed.RISK_LEVELS_TH)


def map_label(name: Column, mapping: Mapping[str, int]) -> Column:
    """Label id of a name; null when the name is not mapped."""
    result = F.lit(None).cast("int")
    for key, value in reversed(list(mapping.items())):
        result = F.when(name == key, F.lit(value)).otherwise(result)
    return result


def label_id(name: Column) -> Column:
    """Label id of a name; unknown names count as ham."""
    known = {name_: i for i, name_ in enumerate(fixed.LABELS)}
    return F.coalesce(map_label(name, known), F.lit(0))


def argmax(probabilities: Column) -> Column:
    """Index of the largest entry, the lowest index on ties."""
    return bind(probabilities, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def softmax(logits: Sequence[Column]) -> Column:
    """Class probabilities as an array, stable for large logits.

    Each logit is evaluated once, however often the formula mentions it.
    """

    def normalise(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(powers, lambda x: x / t))

    return bind(
        F.array(*logits),
        lambda values: bind(
            F.array_max(values),
            lambda top: bind(F.transform(values, lambda x: F.exp(x - top)), normalise),
        ),
    )


def soft_vote(probabilities: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of several probability arrays."""
    classes = len(fixed.LABELS)
    total = float(sum(weights))
    return F.array(
        *[
            sum((F.get(p, F.lit(k)) * w for p, w in zip(probabilities, weights)), F.lit(0.0)) / total
            for k in range(classes)
        ]
    )


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def round4(value: Column) -> Column:
    return F.round(value, 4)
