import json

import pytest
from pyspark.sql import functions as F

from msgsieve.operators.augment import generate_corpus
from msgsieve.plans import ingest
from msgsieve.sources import corpora, logs, schemas


@pytest.fixture
def tsv(tmp_path):
    path = tmp_path / "corpus.tsv"
    path.write_text(
        'ham\tGo until "jurong" point\n'
        "spam\tFree prize, call now\n"
        'ham\t"starts with a quote\nham\tand swallows a line" end\n'
        "other\tunknown label\n"
        "ham\tNA\n"
        "spam\tFree prize, call now\n",
        encoding="utf-8",
    )
    return str(path)


def test_tsv_quotes_may_span_lines(spark, tsv):
    rows = [r["text"] for r in corpora.scan_tsv(spark, tsv).collect()]
    assert len(rows) == 6
    assert rows[2].startswith("starts with a quote\nham\tand swallows a line")
    assert corpora.scan_tsv(spark, tsv, multi_line=False).count() == 7


def test_tsv_normalisation(spark, tsv):
    rows = corpora.load_tsv_corpus(spark, tsv).orderBy("label", "text").collect()
    assert [r["label"] for r in rows] == [0, 0, 1, 1]  # unmapped label and missing text are gone
    assert rows[2]["text"] == "ฟรี รางวัล, โทรเดี๋ยวนี้" and rows[2]["source"] == "uci_sms_spam"
    again = corpora.load_tsv_corpus(spark, tsv).orderBy("label", "text").collect()
    assert rows == again
    assert all("2022-01-01" <= r["created_at"][:10] <= "2024-01-01" for r in rows)


def test_missing_corpora_are_skipped(spark, tsv, tmp_path):
    assert corpora.load_csv_corpus(spark, str(tmp_path / "no.csv")) is None
    assert corpora.load_tsv_corpus(spark, str(tmp_path / "no.tsv")) is None
    merged = ingest.merge(corpora.load_csv_corpus(spark, str(tmp_path / "no.csv")), corpora.load_tsv_corpus(spark, tsv))
    assert merged.count() == 3
    with pytest.raises(ValueError):
        corpora.union_corpora(None, None)


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "messages.csv"
    path.write_text(
        "﻿message_id,text,label,label_name,source,created_at\n"
        '1,"two\nlines, ""quoted""",1,spam,synthetic,2024-01-01 00:00:00\n',
        encoding="utf-8",
    )
    row = corpora.load_csv_corpus(spark, str(path)).first()
    assert row["message_id"] == "1" and row["text"] == 'two\nlines, "quoted"' and row["label"] == 1


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_ingest_writes_disjoint_splits(spark, tsv, tmp_path, file_format):
    out, csv = str(tmp_path / "out"), str(tmp_path / "generated.csv")
    paths = ingest.ingest(spark, out, csv_path=csv, tsv_path=tsv, file_format=file_format)
    assert set(paths) == {"train", "val", "test"}
    if file_format == "csv":
        written = {n: corpora.scan_csv(spark, p) for n, p in paths.items()}
    else:
        written = {n: spark.read.parquet(p) for n, p in paths.items()}
    texts = {n: {r["text"] for r in df.select("text").collect()} for n, df in written.items()}
    sizes = {n: df.count() for n, df in written.items()}
    total = sum(sizes.values())
    assert not (texts["train"] & texts["val"]) and not (texts["train"] & texts["test"])
    assert sum(len(t) for t in texts.values()) == total
    assert abs(sizes["train"] / total - 0.70) < 0.03 and abs(sizes["val"] / total - 0.15) < 0.03


def test_generated_corpus_survives_csv(spark, tmp_path):
    made = generate_corpus(spark, 5, 4, 3, seed=0)
    path = corpora.write_corpus(made, str(tmp_path / "c.csv"))
    assert sorted(corpora.scan_csv(spark, path).collect()) == sorted(made.collect())


def _scored(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("message_id"),
        F.repeat(F.lit("x\n"), 400).alias("text"),
        F.lit("spam").alias("label"),
        F.lit(1).alias("label_id"),
        F.lit(0.9).alias("confidence"),
        F.lit("high").alias("risk_level"),
        F.lit(None).cast("double").alias("processing_time_ms"),
        F.lit("").alias("user_id"),
        F.lit("ml").alias("confidence_source"),
        F.array(F.lit("k")).alias("keywords"),
        F.struct(F.lit(0.05).alias("ham"), F.lit(0.9).alias("spam"), F.lit(0.05).alias("phishing")).alias("probabilities"),
    )


def test_log_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = logs.prediction_log(_scored(spark, 3))
    logs.append_batch(rows, path, "a", 1)
    logs.append_batch(rows, path, "a", 1)
    logs.append_batch(logs.prediction_log(_scored(spark, 2)), path, "a", 2)
    back = logs.scan_predictions(spark, path)
    assert back.count() == 5
    assert back.select(F.max(F.length("text"))).first()[0] == 500
    assert back.where("created_at is null").count() == 0


def test_telemetry(spark):
    row = logs.telemetry(_scored(spark, 1)).first()
    assert row["tags"]["user_id"] == "anonymous" and "\n" not in row["tags"]["text_preview"]
    assert len(row["tags"]["text_preview"]) == 200
    assert row["params"] == {"text_length": 800, "keywords_count": 1}
    assert row["metrics"]["processing_time_ms"] == 0.0 and row["metrics"]["prob_spam"] == 0.9


def test_schema_document(spark, tmp_path):
    path = corpora.write_schema(spark, str(tmp_path / "schema"))
    document = json.loads(spark.read.text(path).first()[0])
    label = next(f for f in document["raw"]["fields"] if f["name"] == "label")
    assert label["metadata"]["values"] == [0, 1, 2]
    assert len(document["processed"]["fields"]) == len(schemas.RAW.fields) + 8
