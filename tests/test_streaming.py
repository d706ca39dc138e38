"""Streams give what the batch gives."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from msgsieve import fixed_values as fixed
from msgsieve.operators import stats
from msgsieve.plans import catalog, score
from msgsieve.sources import logs, schemas
from msgsieve.sources.webhooks import text_events
from msgsieve.streaming import jobs


def risky_when_it_says_free(df):
    risky = F.contains("text", F.lit("free"))
    return df.withColumn(
        "proba",
        F.when(risky, F.array(F.lit(0.1), F.lit(0.85), F.lit(0.05))).otherwise(F.array(F.lit(0.9), F.lit(0.05), F.lit(0.05))),
    )


REQUEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("message_id", "text", "user_id")] + [T.StructField("at", T.TimestampType())]
)


def _write_requests(spark, path):
    for part in range(3):
        rows = spark.range(part * 20, part * 20 + 20).select(
            F.col("id").cast("string").alias("message_id"),
            F.when(F.col("id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("free or not "), F.when(F.col("id") % 2 == 0, "free").otherwise("x"))).alias("text"),
            F.lit("u").alias("user_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("at"),
        )
        rows.write.mode("append").parquet(path)


def test_scoring_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_requests(spark, source)
    stream = jobs.file_stream(spark, source, REQUEST, maxFilesPerTrigger=4)
    jobs.run_available(jobs.score_stream(stream, risky_when_it_says_free, out, f"{out}/cp", created_at="at"))
    written = logs.scan_predictions(spark, f"{out}/predictions")
    requests = spark.read.parquet(source).withColumn("created_at", F.col("at"))
    batch = score.score_messages(score.accepted(score.check_requests(requests)), risky_when_it_says_free)
    want = logs.prediction_log(batch, F.col("created_at"))
    columns = [c for c in want.columns if c != "processing_time_ms"]
    assert sorted(written.select(columns).collect()) == sorted(want.select(columns).collect())
    assert written.where("processing_time_ms is null").count() == 0
    rejected = spark.read.parquet(f"{out}/rejected/job=*/batch=*")
    assert rejected.count() + written.count() == 60
    assert spark.read.parquet(f"{out}/telemetry/job=*/batch=*").count() == written.count()
    # starting again finds nothing new
    jobs.run_available(jobs.score_stream(stream, risky_when_it_says_free, out, f"{out}/cp", created_at="at"))
    assert logs.scan_predictions(spark, f"{out}/predictions").count() == written.count()


def _body(*events):
    return json.dumps({"destination": "d", "events": list(events)}, ensure_ascii=False)


def _event(token, text=None, kind="message", content="text"):
    message = {"type": content, "id": "1", **({"text": text} if text is not None else {})}
    return {"type": kind, "replyToken": token, "source": {"type": "user", "userId": "u1"}, "message": message}


@pytest.mark.parametrize("scorer,texts", [(risky_when_it_says_free, None), (None, fixed.REPLY_NOT_READY)])
def test_webhook_stream(spark, tmp_path, scorer, texts):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    bodies = [
        _body(_event("t1", "free money"), _event("t2", "hello"), _event("t3", content="sticker")),
        _body(),
        _body(_event("t4", kind="follow")),
        "not json",
    ]
    spark.createDataFrame([(b,) for b in bodies], "body string").write.parquet(source)
    stream = jobs.file_stream(spark, source, T.StructType([T.StructField("body", T.StringType())]))
    jobs.run_available(jobs.webhook_stream(stream, scorer, out, f"{out}/cp"))
    replies = {r["reply_token"]: r for r in spark.read.parquet(f"{out}/replies/job=*/batch=*").collect()}
    if texts is None:
        assert set(replies) == {"t1"}
        assert replies["t1"]["user_id"] == "u1" and "85%" in replies["t1"]["reply"]
    else:
        assert {r["reply"] for r in replies.values()} == {texts} and set(replies) == {"t1", "t2"}


def test_an_event_without_a_score_gets_an_apology_and_others_their_reply(spark, tmp_path):
    def partly(df):
        return risky_when_it_says_free(df).withColumn("proba", F.when(F.col("text") != "bad", F.col("proba")))

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    body = _body(_event("t1", "bad"), _event("t2", "free"), _event("t3", "hello"))
    spark.createDataFrame([(body,), (body,)], "body string").write.parquet(source)  # delivered twice
    stream = jobs.file_stream(spark, source, T.StructType([T.StructField("body", T.StringType())]))
    jobs.run_available(jobs.webhook_stream(stream, partly, out, f"{out}/cp"))
    rows = spark.read.parquet(f"{out}/replies/job=*/batch=*").collect()
    replies = {r["reply_token"]: r["reply"] for r in rows}
    assert len(rows) == 2 and replies["t1"] == fixed.REPLY_FAILED and "85%" in replies["t2"]


def test_a_failing_batch_is_not_answered(spark, tmp_path):
    def broken(df):
        raise RuntimeError("model failed")

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(_body(_event("t1", "x")),)], "body string").write.parquet(source)
    stream = jobs.file_stream(spark, source, T.StructType([T.StructField("body", T.StringType())]))
    with pytest.raises(Exception, match="model failed"):
        jobs.run_available(jobs.webhook_stream(stream, broken, out, f"{out}/cp"))
    jobs.run_available(jobs.webhook_stream(stream, risky_when_it_says_free, out, f"{out}/cp"))  # repeated


def test_two_streams_into_one_log_keep_all_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    for part, count in (("a", 2), ("b", 1)):
        source = str(tmp_path / part)
        rows = spark.range(count).select(
            F.concat(F.lit(part), "id").alias("message_id"), F.lit("free").alias("text"), F.lit("u").alias("user_id"),
            F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
        rows.write.parquet(source)
        stream = jobs.file_stream(spark, source, REQUEST)
        jobs.run_available(jobs.score_stream(stream, risky_when_it_says_free, out, str(tmp_path / f"cp-{part}"), created_at="at"))
    written = logs.scan_predictions(spark, f"{out}/predictions")
    assert written.count() == 3
    job = written.groupBy("job").count().where("count = 2").first()["job"]
    logs.append_batch(written.where(F.col("job") == job).drop("job", "batch", "day"), f"{out}/again", job)
    logs.append_batch(written.where(F.col("job") == job).drop("job", "batch", "day"), f"{out}/again", job)  # replaces itself
    assert logs.scan_predictions(spark, f"{out}/again").count() == 2
    logs.compact_job(spark, f"{out}/predictions", job, f"{out}/compact")
    assert logs.scan_predictions(spark, f"{out}/compact").count() == 2


def test_feedback_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("t" * 600, "ham", "spam", "u"), ("t", "ham", "bad", None), ("", "ham", "ham", None)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "predicted_label", "actual_label", "user_id")])
    spark.createDataFrame(rows, schema).write.parquet(source)
    jobs.run_available(jobs.feedback_stream(jobs.file_stream(spark, source, schema), out, f"{out}/cp"))
    kept = logs.scan_feedback(spark, f"{out}/feedback").collect()
    assert len(kept) == 1 and len(kept[0]["text"]) == 500 and kept[0]["created_at"] is not None
    assert spark.read.parquet(f"{out}/rejected/job=*/batch=*").count() == 2


def test_statistics_stream_closes_periods(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("label"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("created_at"),
    )
    rows.write.parquet(source)
    stream = jobs.file_stream(spark, source, rows.schema)
    jobs.run_available(jobs.stats_stream(stream, f"{out}/rows", f"{out}/cp"))
    got = spark.read.parquet(f"{out}/rows")
    whole = stats.windowed_stats(spark.read.parquet(source))
    last = rows.agg(F.max("created_at") - F.expr("interval 10 minutes")).first()[0]
    assert sorted(got.collect()) == sorted(whole.where(F.col("period_end") <= F.lit(last)).collect())


def test_redelivered_events_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("at", T.TimestampType())])
    rows = spark.range(50).select((F.col("id") % 10).cast("string").alias("message_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))
    rows.write.parquet(source)
    once = jobs.drop_redelivered(jobs.file_stream(spark, source, schema), "at")
    jobs.run_available(
        once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    )
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize("name", ["stream_scoring", "stream_windowed_stats"])
def test_streams_of_tables_in_several_files(name, spark, data, tmp_path):
    for table in ("documents", "events"):
        spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    want = sorted(map(str, catalog.QUERIES[name](spark, data).collect()))
    assert want and sorted(map(str, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == want


def unsure_when_it_asks(df):
    unsure = F.contains("text", F.lit("?"))
    return df.withColumn(
        "proba",
        F.when(unsure, F.array(F.lit(0.3), F.lit(0.6), F.lit(0.1))).otherwise(F.array(F.lit(0.9), F.lit(0.05), F.lit(0.05))),
    )


def _answer(label, confidence=0.9):
    return json.dumps({"label": label, "confidence": confidence, "reason": label})


def test_arbitration_stream_waits_for_answers(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    message = "message_id string, text string, user_id string, minute long"
    answer = "message_id string, response string, minute long"

    def arrive(kind, rows, schema, column):
        found = spark.createDataFrame(rows, schema).withColumn(
            column, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60))
        found.drop("minute").coalesce(1).write.mode("append").parquet(f"{source}/{kind}")
        return found.drop("minute").schema

    def step():
        messages = jobs.file_stream(spark, f"{source}/messages", sent)
        answers = jobs.file_stream(spark, f"{source}/answers", told)
        jobs.run_available(jobs.arbitrate_stream(messages, answers, unsure_when_it_asks, out, f"{out}/cp"))
        rows = spark.read.parquet(f"{out}/records/job=*/batch=*").collect()
        assert logs.scan_predictions(spark, f"{out}/predictions").count() == len(rows)
        return rows

    sent = arrive("messages", [
        ("sure", "hello", "u", 0), ("agree", "a?", "u", 0), ("differ", "b?", "u", 0), ("late", "c?", "u", 0),
        ("missing", "d?", "u", 0), ("early", "e?", "u", 30), ("broken", "f?", "u", 0), ("twice", "g?", "u", 0),
        ("edge", "h?", "u", 0), ("agree", "a?", "u", 0), (None, "i?", "u", 0), (None, "i?", "v", 0), (None, None, None, None),
    ], message, "created_at")
    told = arrive("answers", [("sure", _answer("spam"), 1)], answer, "answered_at")
    first = step()  # confident messages and those that cannot ask leave at once
    assert sorted((r["message_id"] or "", r["label"]) for r in first) == [("", "ham"), ("", "spam"), ("", "spam"), ("sure", "ham")]
    arrive("answers", [
        ("agree", _answer("spam"), 5), ("differ", _answer("phishing"), 5), ("late", _answer("ham"), 61), ("early", _answer("ham"), 29),
        ("broken", "no answer", 5), ("twice", _answer("ham"), 5), ("edge", _answer("ham"), 60), ("nobody", _answer("ham"), 5),
        (None, _answer("ham"), 5), ("missing", _answer("ham"), None),
    ], answer, "answered_at")
    step()
    arrive("answers", [("twice", _answer("phishing"), 55), ("broken", _answer("phishing"), 58)], answer, "answered_at")
    answered = {r["message_id"]: (r["label"], r["confidence"], r["confidence_source"]) for r in step() if r["message_id"]}
    assert answered == {
        "sure": ("ham", 0.9, "ml"), "agree": ("spam", 0.75, "hybrid"), "differ": ("phishing", 0.9, "hybrid"),
        "twice": ("ham", 0.9, "hybrid"), "edge": ("ham", 0.9, "hybrid"), "broken": ("phishing", 0.9, "hybrid"),
    }
    arrive("messages", [("end", "hello", "u", 1000)], message, "created_at")
    arrive("answers", [("end", _answer("ham"), 1000)], answer, "answered_at")
    step()
    rows = step()
    final = {r["message_id"]: (r["label"], r["confidence_source"]) for r in rows if r["message_id"]}
    assert len(rows) == 13 - 1 + 1  # one redelivered, one to end the wait
    assert {k: final[k] for k in ("late", "missing", "early")} == dict.fromkeys(("late", "missing", "early"), ("spam", "ml"))


def _stores(checkpoint):
    """What kind of state store a checkpoint's batches have used."""
    lines = [line for path in Path(checkpoint, "offsets").iterdir() if path.name.isdigit() for line in path.read_text().splitlines()]
    return {json.loads(line)["conf"]["spark.sql.streaming.stateStore.providerClass"].rpartition(".")[2] for line in lines if '"conf"' in line}


def test_arbitration_keeps_waiting_texts_in_files(spark, tmp_path, monkeypatch):
    """The query's texts wait in files, not on the heap; streams after it have the session's own settings."""
    rows = [(k, f"text {k} www.a.example!!" if k % 5 else None) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], jobs.arbitrate_stream
    monkeypatch.setattr(jobs, "arbitrate_stream", lambda *a, **k: seen.append(a[4]) or real(*a, **k))
    found = catalog.stream_arbitration(spark, str(tmp_path)).collect()
    assert sorted(int(r["message_id"]) for r in found) == list(range(40))
    assert _stores(seen[0].removeprefix("file:")) == {"RocksDBStateStoreProvider"}
    key = f"{jobs.STATE_STORE}.providerClass"
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "of.the.session")
    try:
        with jobs.state_on_disk(spark):
            assert spark.conf.get(key) == "of.the.session"
        assert spark.conf.get(key) == "of.the.session"
    finally:
        spark.conf.unset(key)


def test_requests_without_an_id_are_all_kept(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(None, "free", "u1"), (None, "free", "u2"), (None, "free", "u2"), ("a", "free", "u1"), ("a", "free", "u1")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("message_id", "text", "user_id")])
    spark.createDataFrame(rows, schema).write.parquet(source)
    jobs.run_available(jobs.score_stream(jobs.file_stream(spark, source, schema), risky_when_it_says_free, out, f"{out}/cp"))
    assert logs.scan_predictions(spark, f"{out}/predictions").count() == 4


def test_events_without_a_token_have_ids_of_their_own(spark):
    twin = _event(None, "free")
    bodies = [(_body(twin, twin),), (_body(_event("t", "free")),), (_body(_event("t", "free")),), (_body(twin, twin),)]
    ids = [r["message_id"] for r in text_events(spark.createDataFrame(bodies, "body string")).collect()]
    assert len(ids) == 6 and len(set(ids)) == 3  # the same body again is the same events


def test_user_counters_go_on_after_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id string, label string"
    batches = [[("a", "spam"), ("a", "ham"), ("b", "phishing"), (None, "ham")], [("a", "phishing"), ("c", "ham"), ("a", None)]]
    for rows in batches:
        found = spark.createDataFrame(rows, schema)
        found.coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(jobs.user_counter_stream(jobs.file_stream(spark, source, found.schema), out, f"{out}/cp"))
        whole = stats.user_counters(spark.read.parquet(source)).collect()
        assert sorted(map(str, jobs.latest_counters(spark, out).collect())) == sorted(map(str, whole))
    changed = spark.read.parquet(f"{out}/counters/job=*/batch=1")
    assert {r["user_id"] for r in changed.collect()} == {"a", "c"}  # only the users of that batch
    jobs.run_available(jobs.user_counter_stream(jobs.file_stream(spark, source, found.schema), out, f"{out}/other"))
    twice = {r["user_id"]: r["total_checked"] for r in jobs.latest_counters(spark, out).collect()}
    assert twice == {"a": 8, "b": 2, "c": 2, None: 2}  # another job's totals are added
