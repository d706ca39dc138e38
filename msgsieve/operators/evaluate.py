"""Classification metrics from counts.

Every metric but AUC is derived from the nine cells of the confusion matrix,
which one aggregation without a join produces, zero cells included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.operators.ordered import running_before

K = range(len(fixed.LABELS))


def _cell(actual: int, predicted: int) -> str:
    return f"c{actual}{predicted}"


def confusion_row(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The nine cells as one row; labels outside 0..2 are not counted."""
    return df.agg(
        *[
            F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(_cell(a, p))
            for a in K
            for p in K
        ]
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(actual, predicted, n)`` for all nine pairs."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(_cell(a, p)).alias("n"))
        for a in K
        for p in K
    ]
    return confusion_row(df, label, prediction).select(F.inline(F.array(*cells)))


def overall_metrics_by(df: DataFrame, group: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``overall_metrics`` of each group."""
    cells = [F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(_cell(a, p)) for a in K for p in K]
    columns = _overall_columns()
    return df.groupBy(group).agg(*cells).select(group, *[v.alias(n) for n, v in columns.items()])


def _ratio(part: Column, whole: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _class_columns(k: int) -> dict[str, Column]:
    hit = F.col(_cell(k, k))
    actual = sum((F.col(_cell(k, p)) for p in K), F.lit(0))
    predicted = sum((F.col(_cell(a, k)) for a in K), F.lit(0))
    return {
        "precision": _ratio(hit, predicted),
        "recall": _ratio(hit, actual),
        "f1": _ratio(2 * hit, actual + predicted),
        "support": actual,
        "predicted": predicted,
    }


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support for each of the three classes."""
    rows = []
    for k in K:
        columns = _class_columns(k)
        rows.append(
            F.struct(
                F.lit(k).alias("label_id"),
                F.lit(fixed.LABELS[k]).alias("class"),
                *[columns[name].alias(name) for name in ("precision", "recall", "f1", "support", "predicted")],
            )
        )
    return confusion_row(df, label, prediction).select(F.inline(F.array(*rows)))


def _overall_columns() -> dict[str, Column]:
    """Accuracy, weighted and macro averages from the one-row confusion."""
    per_class = [_class_columns(k) for k in K]
    total = sum((c["support"] for c in per_class), F.lit(0))
    seen = [(c["support"] + c["predicted"] > 0).cast("int") for c in per_class]
    n_seen = sum(seen, F.lit(0))

    def weighted(name: str) -> Column:
        return _ratio(sum((c[name] * c["support"] for c in per_class), F.lit(0.0)), total)

    def macro(name: str) -> Column:
        return _ratio(sum((c[name] * s for c, s in zip(per_class, seen)), F.lit(0.0)), n_seen)

    columns = {"accuracy": _ratio(sum((F.col(_cell(k, k)) for k in K), F.lit(0)), total)}
    for average, function in (("weighted", weighted), ("macro", macro)):
        columns |= {f"{name}_{average}": function(name) for name in ("precision", "recall", "f1")}
    return {**columns, "support": total}


def overall_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of accuracy, weighted and macro averages.

    Macro averages run over the classes seen in truth or prediction.
    """
    columns = _overall_columns()
    return confusion_row(df, label, prediction).select(*[v.alias(n) for n, v in columns.items()])


def auc_by_class(df: DataFrame, label: str = "label", probabilities: str = "proba") -> DataFrame:
    """Exact one-vs-rest AUC per class: ``(label_id, positives, negatives, auc)``.

    Scores are reduced to one row per (class, score) first; the rank sum then
    needs the number of negatives below each score, which is a running total
    split into ranges.  A class without positives or negatives has a null AUC.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("label_id"),
                    F.get(probabilities, F.lit(k)).alias("score"),
                    (F.col(label) == k).cast("bigint").alias("hit"),
                )
                for k in K
            ]
        )
    )
    counted = (
        df.where(F.col(label).isin(list(K)))
        .select(pairs.alias("_p"))
        .groupBy("_p.label_id", "_p.score")
        .agg(F.sum("_p.hit").alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    ranked = running_before(counted, ["label_id"], "score", ["pos", "n"])
    negatives, below = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    # decimal sums: the products may pass the exact range of doubles
    wins = F.col("pos").cast("decimal(20,0)") * (2 * below + negatives).cast("decimal(20,0)")
    return ranked.groupBy("label_id").agg(
        F.max("pos_total").alias("positives"),
        F.max(F.col("n_total") - F.col("pos_total")).alias("negatives"),
        F.sum(wins).cast("double").alias("_twice"),
    ).select(
        "label_id",
        "positives",
        "negatives",
        F.try_divide(
            F.col("_twice"), F.col("positives").cast("double") * F.col("negatives") * 2
        ).alias("auc"),
    )


def auc_summary(by_class: DataFrame) -> DataFrame:
    """Prevalence-weighted and macro AUC; null unless every class has one."""
    complete = (F.count("auc") == len(fixed.LABELS))
    return by_class.agg(
        F.when(complete, F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc_roc_weighted"),
        F.when(complete, F.avg("auc")).alias("auc_roc_macro"),
    )


def metrics_table(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    probabilities: str | None = "proba",
) -> DataFrame:
    """Long table ``(metric, class, value)`` of everything above.

    Per-class rows appear only for classes with support, AUC rows only when
    they can be computed.
    """
    none = F.lit(None).cast("string")
    overall = _overall_columns()
    entries = [
        F.struct(F.lit(n).alias("metric"), none.alias("class"), overall[n].cast("double").alias("value"))
        for n in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro")
    ]
    for k in K:
        columns = _class_columns(k)
        for name in ("precision", "recall", "f1"):
            value = columns[name].cast("double").alias("value")
            entry = F.struct(F.lit(name).alias("metric"), F.lit(fixed.LABELS[k]).alias("class"), value)
            entries.append(F.when(columns["support"] > 0, entry))
    row = confusion_row(df, label, prediction)
    table = row.select(F.inline(F.array_compact(F.array(*entries))))
    if probabilities is not None:
        summary = auc_summary(auc_by_class(df, label, probabilities))
        auc = [
            F.struct(F.lit(n).alias("metric"), none.alias("class"), F.col(n).alias("value")) for n in summary.columns
        ]
        table = table.unionByName(summary.select(F.inline(F.array(*auc))).where(F.col("value").isNotNull()))
    return table


def report_rows(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows of the classification report: classes, accuracy, macro, weighted."""
    row = confusion_row(df, label, prediction)
    per_class = [_class_columns(k) for k in K]
    total = sum((c["support"] for c in per_class), F.lit(0))
    hits = sum((F.col(_cell(k, k)) for k in K), F.lit(0))
    accuracy = _ratio(hits, total)
    empty = F.lit(None).cast("double")

    def line(position: int, name: str, values: Sequence[Column], support: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("row"),
            *[v.alias(n) for n, v in zip(("precision", "recall", "f1"), values)],
            support.cast("bigint").alias("support"),
        )

    measures = ("precision", "recall", "f1")
    lines = [line(k, fixed.LABELS[k], [per_class[k][m] for m in measures], per_class[k]["support"]) for k in K]
    size = len(fixed.LABELS)
    lines.append(line(size, "accuracy", [empty, empty, accuracy], total))
    lines.append(
        line(size + 1, "macro avg", [sum((c[m] for c in per_class), F.lit(0.0)) / size for m in measures], total)
    )
    lines.append(
        line(
            size + 2,
            "weighted avg",
            [_ratio(sum((c[m] * c["support"] for c in per_class), F.lit(0.0)), total) for m in measures],
            total,
        )
    )
    return row.select(F.inline(F.array(*lines)))


def report_text(df: DataFrame, label: str = "label", prediction: str = "prediction") -> str:
    """The classification report as text (six rows)."""
    rows = report_rows(df, label, prediction).orderBy("position").collect()

    def number(value: float | None) -> str:
        return " " * 10 if value is None else f"{value:>10.2f}"

    lines = [f"{'':>12} {'precision':>10}{'recall':>10}{'f1-score':>10}{'support':>10}", ""]
    for r in rows:
        if r["row"] == "accuracy":
            lines.append("")
        lines.append(
            f"{r['row']:>12} {number(r['precision'])}{number(r['recall'])}{number(r['f1'])}{r['support']:>10}"
        )
    return "\n".join(lines)
