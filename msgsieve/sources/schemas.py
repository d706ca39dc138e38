"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

from msgsieve import fixed_values as fixed


def _field(name: str, kind: T.DataType, nullable: bool, **metadata) -> T.StructField:
    return T.StructField(name, kind, nullable, metadata or None)


RAW = T.StructType(
    [
        _field("message_id", T.StringType(), False, description="Unique id per message"),
        _field("text", T.StringType(), False, min_length=5, max_length=1000),
        _field("label", T.IntegerType(), False, values=[0, 1, 2]),
        _field("label_name", T.StringType(), False, values=fixed.LABELS),
        _field("source", T.StringType(), False),
        _field("created_at", T.StringType(), False, format="YYYY-MM-DD HH:MM:SS"),
    ]
)

SIGNAL_TYPES = {
    name: T.DoubleType() if name.endswith("_ratio") else T.IntegerType() for name in fixed.SIGNALS
}

PROCESSED = T.StructType(
    RAW.fields
    + [_field("text_clean", T.StringType(), False, description="Prepared text")]
    + [_field(name, kind, False) for name, kind in SIGNAL_TYPES.items()]
)

CSV_MESSAGES = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW.fields])

TSV_CORPUS = T.StructType(
    [T.StructField("label_name", T.StringType()), T.StructField("text", T.StringType())]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_id", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("processing_time_ms", T.DoubleType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

FEEDBACK_LOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("actual_label", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

MODEL_RUNS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("train_samples", T.LongType()),
        T.StructField("val_samples", T.LongType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model_path", T.StringType()),
    ]
)

WEBHOOK_BODY = T.StructType(
    [
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("replyToken", T.StringType()),
                        T.StructField(
                            "source", T.StructType([T.StructField("userId", T.StringType())])
                        ),
                        T.StructField(
                            "message",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField("text", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
