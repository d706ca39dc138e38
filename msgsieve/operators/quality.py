"""Schema and quality reports over raw and prepared messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from msgsieve import fixed_values as fixed
from msgsieve.operators.dedup import duplicate_count
from msgsieve.sources import schemas

Rule = tuple[str, str, Column]  # name, column, condition that a good row meets

LABEL_IDS = list(range(len(fixed.LABELS)))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label with their share; rows without a label are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def raw_rules(min_length: int = 5, max_length: int = 1000) -> list[Rule]:
    length = F.length("text")
    not_null = [(f"{c}_not_null", c, F.col(c).isNotNull()) for c in schemas.RAW.fieldNames()]
    return not_null + [
        ("text_too_short", "text", length >= min_length),
        ("text_too_long", "text", length <= max_length),
        ("label_in_set", "label", F.col("label").isin(LABEL_IDS)),
        ("label_name_in_set", "label_name", F.col("label_name").isin(fixed.LABELS)),
    ]


def processed_rules() -> list[Rule]:
    numeric = ["text_length", "url_count", "phone_count"]
    columns = ["text_clean", "label", *numeric]
    return [
        *[(f"{c}_not_null", c, F.col(c).isNotNull()) for c in columns],
        ("text_clean_blank", "text_clean", F.length(F.trim("text_clean")) > 0),
        ("label_in_set", "label", F.col("label").isin(LABEL_IDS)),
        *[(f"{c}_negative", c, F.col(c) >= 0) for c in numeric],
    ]


def _breaks(condition: Column) -> Column:
    """Value rules skip nulls: only a false condition is a violation."""
    return F.coalesce(~condition, F.lit(False))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violating rows with the names of the rules they break."""
    usable = [r for r in rules if r[1] in df.columns]
    names = F.array_compact(F.array(*[F.when(_breaks(ok), F.lit(name)) for name, _, ok in usable]))
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule, all counted in one pass: ``(rule, column, n)``."""
    usable = [r for r in rules if r[1] in df.columns]
    one_row = df.agg(*[F.count_if(_breaks(ok)).alias(name) for name, _, ok in usable])
    entries = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("column"), F.col(n).alias("n")) for n, c, _ in usable]
    )
    return one_row.select(F.inline(entries))


def _type_issues(df: DataFrame, expected: dict[str, type | tuple]) -> list[str]:
    issues = []
    for name, kinds in expected.items():
        if name not in df.columns:
            issues.append(f"Schema: column '{name}' is missing")
        elif not isinstance(df.schema[name].dataType, kinds):
            issues.append(f"Schema: column '{name}' has type {df.schema[name].dataType.simpleString()}")
    return issues


RAW_TYPES = {
    "message_id": T.StringType,
    "text": T.StringType,
    "label": T.IntegralType,
    "label_name": T.StringType,
    "source": T.StringType,
    "created_at": (T.StringType, T.TimestampType),
}
PROCESSED_TYPES = {
    "text_clean": T.StringType,
    "label": T.IntegralType,
    "text_length": T.NumericType,
    "url_count": T.NumericType,
    "phone_count": T.NumericType,
}


def _report(
    by_label: DataFrame,
    rules: Sequence[Rule],
    stats: dict[str, Column],
    type_issues: list[str],
    extra_issues: Sequence[Column],
) -> DataFrame:
    """Turn per-label partial counts into the one-row report."""
    dist = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col(f"label_{k}") > 0, F.struct(F.lit(k).alias("key"), F.col(f"label_{k}").alias("value")))
                    for k in LABEL_IDS
                ]
            )
        )
    )
    issues = [F.lit(issue) for issue in type_issues]
    issues += [
        F.when(
            F.col(name) > 0,
            F.concat(F.lit(f"Schema: {name} failed on column '{column}' ("), F.col(name).cast("string"), F.lit(" rows)")),
        )
        for name, column, _ in rules
    ]
    issues += list(extra_issues)
    compact = F.array_compact(F.array(F.lit(None).cast("string"), *issues))
    flat = [part for k, v in stats.items() for part in (F.lit(k), v.cast("double"))]
    return by_label.select(
        (F.size(compact) == 0).alias("passed"),
        F.col("total_rows").alias("n_rows"),
        dist.alias("label_distribution"),
        compact.alias("issues"),
        F.create_map(*flat).alias("stats"),
    )


def _per_label(df: DataFrame, rules: Sequence[Rule], sums: dict[str, Column]) -> DataFrame:
    """One scan: counts and sums per label, then folded to one row.

    The first step gives one row per label and task, however the labels are
    skewed; the second step only sees those.
    """
    grouped = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(_breaks(ok)).alias(name) for name, _, ok in rules],
        *[value.alias(name) for name, value in sums.items()],
    )
    labelled = F.col("label").isNotNull()
    fold = {"min": F.min, "max": F.max}
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.max(F.when(labelled, F.struct("_n", "label"))).alias("_largest"),
        F.coalesce(F.min(F.when(labelled, F.col("_n"))), F.lit(0)).alias("_smallest"),
        *[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("_n"))), F.lit(0)).alias(f"label_{k}") for k in LABEL_IDS],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name, _, _ in rules],
        *[fold.get(name.split("_")[0], F.sum)(name).alias(name) for name in sums],
    )


def raw_report(
    df: DataFrame,
    min_length: int = 5,
    max_length: int = 1000,
    dominant_share: float = 0.80,
    min_class: int = 100,
) -> DataFrame:
    """One row: passed, n_rows, label_distribution, issues, stats."""
    rules = [r for r in raw_rules(min_length, max_length) if r[1] in df.columns]
    length = F.length("text")
    sums = {
        "sum_length": F.sum(length.cast("bigint")),
        "n_length": F.count("text"),
        "min_length": F.min(length),
        "max_length": F.max(length),
    }
    folded = _per_label(df, rules, sums).withColumn("n_duplicates", duplicate_count(df).scalar())
    share = F.col("_largest._n") / F.col("total_rows")
    extra = [
        F.when(
            F.col("n_duplicates") > 0,
            F.concat(F.lit("Found "), F.col("n_duplicates").cast("string"), F.lit(" duplicate messages")),
        ),
        F.when(
            share > dominant_share,
            F.format_string("Class %s dominates at %.1f%%", F.col("_largest.label").cast("string"), share * 100),
        ),
        F.when(
            F.col("_smallest") < min_class,
            F.concat(
                F.lit("Smallest class has only "), F.col("_smallest").cast("string"), F.lit(f" samples (min: {min_class})")
            ),
        ),
    ]
    stats = {
        "total_rows": F.col("total_rows"),
        "avg_text_length": F.coalesce(F.try_divide(F.col("sum_length"), F.col("n_length")), F.lit(0.0)),
        "min_text_length": F.coalesce("min_length", F.lit(0)),
        "max_text_length": F.coalesce("max_length", F.lit(0)),
        "n_duplicates": F.col("n_duplicates"),
    }
    return _report(folded, rules, stats, _type_issues(df, RAW_TYPES), extra)


def processed_report(df: DataFrame) -> DataFrame:
    """One-row report on prepared messages; signals may be of any numeric type."""
    rules = [r for r in processed_rules() if r[1] in df.columns]
    sums = {
        "sum_clean": F.sum(F.length("text_clean").cast("bigint")),
        "n_clean": F.count("text_clean"),
        "sum_url": F.sum(F.col("url_count").cast("bigint")),
        "n_url": F.count("url_count"),
        "sum_phone": F.sum(F.col("phone_count").cast("bigint")),
        "n_phone": F.count("phone_count"),
    }
    folded = _per_label(df, rules, sums)
    empty = F.col("text_clean_blank")
    extra = [F.when(empty > 0, F.concat(empty.cast("string"), F.lit(" rows have empty text_clean")))]
    stats = {
        "total_rows": F.col("total_rows"),
        "avg_clean_length": F.try_divide(F.col("sum_clean"), F.col("n_clean")),
        "avg_url_count": F.try_divide(F.col("sum_url"), F.col("n_url")),
        "avg_phone_count": F.try_divide(F.col("sum_phone"), F.col("n_phone")),
        "empty_texts": empty,
    }
    return _report(folded, rules, stats, _type_issues(df, PROCESSED_TYPES), extra)
