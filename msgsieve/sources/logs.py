"""Prediction, feedback, telemetry and model-run logs.

A log is a folder of Parquet batches, ``job=<id>/batch=<n>``.  A job is what writes
batches with numbers of its own, such as a stream with its checkpoint: a batch that
is written again after a failure replaces itself and rows never double, and other
jobs are not touched.  Inside a batch rows are partitioned by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.hashing import stable_id
from msgsieve.sources import schemas

STORED_TEXT = 500
PREVIEW_TEXT = 200


def prediction_log(scored: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows of the prediction log for scored messages."""
    created_at = F.current_timestamp() if created_at is None else created_at
    user = F.col("user_id") if "user_id" in scored.columns else F.lit(None).cast("string")
    return scored.select(
        stable_id(F.col("message_id"), user, F.col("text")).alias("id"),
        F.substring("text", 1, STORED_TEXT).alias("text"),
        "label",
        F.col("label_id").cast("int").alias("label_id"),
        "confidence",
        "risk_level",
        F.col("processing_time_ms").cast("double").alias("processing_time_ms"),
        user.alias("user_id"),
        created_at.cast("timestamp").alias("created_at"),
    )


def feedback_log(feedback: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows of the feedback log for accepted feedback."""
    created_at = F.current_timestamp() if created_at is None else created_at
    user = F.col("user_id") if "user_id" in feedback.columns else F.lit(None).cast("string")
    return feedback.select(
        stable_id(F.col("text"), F.col("predicted_label"), F.col("actual_label"), user, created_at).alias("id"),
        F.substring("text", 1, STORED_TEXT).alias("text"),
        "predicted_label",
        "actual_label",
        user.alias("user_id"),
        created_at.cast("timestamp").alias("created_at"),
    )


def feedback_receipts(logged: DataFrame) -> DataFrame:
    """What the sender of each logged feedback gets back."""
    return logged.select(
        F.col("id").alias("feedback_id"),
        F.lit(fixed.FEEDBACK_THANKS).alias("message"),
        F.col("created_at").alias("saved_at"),
    )


def telemetry(scored: DataFrame) -> DataFrame:
    """Tags, metrics and params of each prediction."""
    user = F.col("user_id") if "user_id" in scored.columns else F.lit(None).cast("string")
    preview = F.replace(F.substring("text", 1, PREVIEW_TEXT), F.lit("\n"), F.lit(" "))

    def entries(pairs: dict[str, Column], kind: str) -> Column:
        flat = [part for name, value in pairs.items() for part in (F.lit(name), value.cast(kind))]
        return F.create_map(*flat)

    return scored.select(
        "message_id",
        entries(
            {
                "label": F.coalesce("label", F.lit("")),
                "risk_level": F.coalesce("risk_level", F.lit("")),
                "confidence_source": F.coalesce("confidence_source", F.lit("ml")),
                "user_id": F.coalesce(F.nullif(user, F.lit("")), F.lit("anonymous")),
                "text_preview": preview,
            },
            "string",
        ).alias("tags"),
        entries(
            {
                "confidence": F.coalesce("confidence", F.lit(0.0)),
                "label_id": F.coalesce("label_id", F.lit(0)),
                "processing_time_ms": F.coalesce("processing_time_ms", F.lit(0.0)),
                "prob_ham": F.col("probabilities.ham"),
                "prob_spam": F.col("probabilities.spam"),
                "prob_phishing": F.col("probabilities.phishing"),
            },
            "double",
        ).alias("metrics"),
        entries(
            {"text_length": F.length("text"), "keywords_count": F.size("keywords")}, "bigint"
        ).alias("params"),
    )


def append_batch(df: DataFrame, path: str, job: str, batch: int = 0, day: str | None = "created_at") -> str:
    """Write one batch of a job; writing the same batch again replaces it."""
    target = f"{path.rstrip('/')}/job={job}/batch={batch}"
    writer = df
    if day is not None:
        writer = df.withColumn("day", F.to_date(day))
        writer.write.mode("overwrite").partitionBy("day").parquet(target)
    else:
        writer.write.mode("overwrite").parquet(target)
    return target


def scan_log(spark: SparkSession, path: str, schema=schemas.PREDICTION_LOG) -> DataFrame:
    """Read a log; job, batch and day are partition columns, so filters on them prune."""
    return spark.read.option("basePath", path).schema(schema).parquet(f"{path.rstrip('/')}/job=*/batch=*")


def compact_job(spark: SparkSession, path: str, job: str, target: str, schema=schemas.PREDICTION_LOG) -> str:
    """Copy the many small batches of a finished job into one batch of another log folder."""
    rows = scan_log(spark, path, schema).where(F.col("job") == job).drop("job", "batch")
    return append_batch(rows.hint("rebalance", "day"), target, job)


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    return scan_log(spark, path, schemas.PREDICTION_LOG)


def scan_feedback(spark: SparkSession, path: str) -> DataFrame:
    return scan_log(spark, path, schemas.FEEDBACK_LOG)


def model_run(spark: SparkSession, **values) -> DataFrame:
    """One row of the ``model_runs`` table from keyword values."""
    row = [values.get(name) for name in schemas.MODEL_RUNS.fieldNames()]
    return spark.createDataFrame([row], schemas.MODEL_RUNS)


def append_model_run(run: DataFrame, path: str, name: str, json_copy: str | None = None) -> None:
    """Append a run; optionally keep a JSON copy next to the model."""
    append_batch(run, path, name, day=None)  # a name of its own, so runs add up
    if json_copy is not None:
        run.write.mode("overwrite").json(json_copy)


def scan_model_runs(spark: SparkSession, path: str) -> DataFrame:
    return scan_log(spark, path, schemas.MODEL_RUNS)
