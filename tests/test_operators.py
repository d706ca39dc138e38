"""Operators against brute force, including skewed input and partitioning."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.functions import labels as lb
from msgsieve.functions import validation
from msgsieve.functions.replies import faq_answer, format_reply
from msgsieve.functions.responses import parse_response
from msgsieve import fixed_values as fixed
from msgsieve.operators import augment, chat, dedup, evaluate, ordered, profile, quality, scoring, split, stats
from msgsieve.operators.prepare import prepare
from msgsieve.plans import ingest
from msgsieve.sources import logs, schemas


def test_keep_first_with_a_text_in_half_the_rows(spark):
    rows = [("hot" if i % 2 else f"t{i % 40}", 1 - i % 2, i, f"m{i}") for i in range(2000)]
    want = {}
    for text, priority, ordinal, name in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(text, name)
    for parts in (1, 16):
        df = spark.createDataFrame(rows, "text string, priority int, ordinal int, m string").repartition(parts)
        got = {r["text"]: r["m"] for r in dedup.keep_first(df).collect()}
        assert got == want
        assert dedup.duplicate_count(df).first()[0] == 2000 - len(want)


def test_duplicate_count_takes_nulls_as_one_text(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "text string")
    assert dedup.duplicate_count(df).first()[0] == 2
    assert dedup.duplicate_count(df.where("text = 'none'")).first()[0] == 0


def test_exact_split_counts(spark):
    sizes = {0: 1000, 1: 333, 2: 1}
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    results = []
    for parts in (1, 16):
        df = spark.createDataFrame(rows, "message_id string, label int").repartition(parts)
        found = split.split_exact(df).collect()
        results.append({r["message_id"]: r["split"] for r in found})
        assert len(found) == len(rows)
        for label, n in sizes.items():
            counts = {s: sum(r["split"] == s for r in found if r["label"] == label) for s in ("train", "val", "test")}
            assert abs(counts["train"] - 0.7 * n) <= 0.5 and abs(counts["test"] - 0.15 * n) <= 1
            assert sum(counts.values()) == n
    assert results[0] == results[1]


def test_exact_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "message_id string, label int")
    assert split.split_exact(df).count() == 2


def test_hash_split_is_stable_and_keeps_copies_together(spark):
    df = spark.range(4000).select(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string")).alias("text"))
    found = split.split_by_hash(df)
    assert found.distinct().count() == 1000
    shares = {r["split"]: r["count"] / 4000 for r in found.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.05


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_before(spark, ranges, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", _into(ranges, type(spark.range(0)).repartitionByRange))
    rng = random.Random(3)
    rows = [(g, float(v), rng.randint(0, 5)) for g in "ab" for v in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = ordered.running_before(df, ["g"], "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_before"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"])
        assert r["n_total"] == sum(n for g, _, n in rows if g == r["g"])


def test_describe_equals_numpy(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "cold", rng.choice([1, 2, 2, 3, 50, rng.randint(0, 400)])) for i in range(1500)] + [("one", 7)]
    df = spark.createDataFrame(rows, "g string, x int")
    for r in ordered.describe(df, "g", ["x"], digits=None).collect():
        values = [x for g, x in rows if g == r["g"]]
        assert r["count"] == len(values) and r["mean"] == pytest.approx(statistics.mean(values))
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))
        if len(values) > 1:
            assert r["std"] == pytest.approx(statistics.stdev(values))
        else:
            assert r["std"] is None
        assert (r["min"], r["max"]) == (min(values), max(values))


def test_histogram(spark):
    rng = random.Random(9)
    rows = [(g, rng.randint(0, 97)) for g in "ab" for _ in range(400)] + [("single", 5)] * 3
    df = spark.createDataFrame(rows, "g string, x int")
    got = {(r["g"], r["bin"]): r["n"] for r in profile.histogram(df, "g", "x", 20).collect()}
    for g in ("a", "b", "single"):
        values = [x for k, x in rows if k == g]
        counts, _ = np.histogram(values, bins=20)
        assert [got.get((g, b), 0) for b in range(20)] == list(counts)


def _into(ranges, plain):
    return lambda df, *columns: plain(df, ranges, *columns)


def test_many_groups(spark):
    """No operator limits the number of groups."""
    n = 12_000
    df = spark.range(2 * n).select(
        (F.col("id") % n).alias("g"), F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"), F.lit("t").alias("text"))
    assert ordered.describe(df, "g", ["x"]).where("count = 2 AND p50 = (min + max) / 2").count() == n
    assert profile.histogram(df, "g", "x", 4).agg(F.sum("n")).first()[0] == 2 * n
    assert split.split_exact(df, "g", "k").groupBy("split").count().count() >= 1
    assert profile.sample_per_class(df, "g", "k").count() == 2 * n


def test_first_of_equal_texts_does_not_depend_on_partitions(spark):
    rows = [("same", label, f"n{label}", f"m{label}-{i}") for i in range(30) for label in (2, 1, 0)] + [("other", 1, "n1", "x")]
    kept = []
    for parts in (1, 16):
        corpus = spark.createDataFrame(rows, "text string, label int, label_name string, message_id string").repartition(parts)
        kept.append(sorted(map(tuple, ingest.merge(corpus).collect())))
    assert kept[0] == kept[1] and [r[1] for r in kept[0]] == [1, 0]


def test_samples_and_shuffle(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.repeat(F.lit("x"), 300).alias("text"))
    one = profile.sample_per_class(df, "g", "id").orderBy("g", "rank").collect()
    two = profile.sample_per_class(df.repartition(16), "g", "id").orderBy("g", "rank").collect()
    assert one == two and len(one) == 6 and len(one[0]["text"]) == 100
    order = [r["id"] for r in profile.shuffled(df.select("id"), "id").collect()]
    assert order != sorted(order) and sorted(order) == list(range(300))


def test_raw_report_on_bad_rows(spark, sample):
    report = quality.raw_report(sample).first()
    assert report["n_rows"] == 6 and report["label_distribution"] == {0: 2, 1: 2, 2: 2}
    assert report["issues"] == ["Smallest class has only 2 samples (min: 100)"]
    rows = [("x", None, 0, "ham", "t", "d"), ("y", "สวัสดี", 99, "unknown", "t", "d"), ("y", "สวัสดี", 99, "unknown", "t", "d")]
    bad = quality.raw_report(spark.createDataFrame(rows, schemas.CSV_MESSAGES)).first()
    assert not bad["passed"] and bad["stats"]["n_duplicates"] == 1
    assert any(i.startswith("Schema: text_not_null") for i in bad["issues"])
    assert any(i.startswith("Schema: label_in_set") for i in bad["issues"])
    empty = quality.raw_report(spark.createDataFrame([], schemas.CSV_MESSAGES)).first()
    assert empty["n_rows"] == 0 and empty["stats"]["max_text_length"] == 0
    wrong = quality.raw_report(sample.withColumn("label", F.col("label").cast("string")).drop("source")).first()
    assert any("missing" in i for i in wrong["issues"]) and any("has type string" in i for i in wrong["issues"])


def test_dominant_class(spark):
    rows = [("m", f"text {i}", int(i >= 270), "ham", "t", "d") for i in range(300)]
    report = quality.raw_report(spark.createDataFrame(rows, schemas.CSV_MESSAGES), min_class=1).first()
    assert report["issues"] == ["Class 0 dominates at 90.0%"]


def test_processed_report(spark, sample):
    assert quality.processed_report(prepare(sample)).first()["passed"]
    broken = prepare(sample).withColumn("url_count", F.lit(-1)).withColumn("text_clean", F.lit(" "))
    report = quality.processed_report(broken).first()
    assert not report["passed"] and "6 rows have empty text_clean" in report["issues"]
    assert quality.violations(broken, quality.processed_rules()).count() == 6


def brute_auc(labels, scores, k):
    pos = [s for y, s in zip(labels, scores) if y == k]
    neg = [s for y, s in zip(labels, scores) if y != k]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("classes", [[0, 1, 2], [0, 1]])
def test_auc_with_ties(spark, classes):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        p = [rng.choice([0.1, 0.2, 0.3, rng.random()]) for _ in range(3)]
        rows.append((rng.choice(classes), p))
    df = spark.createDataFrame(rows, "label int, proba array<double>")
    got = {r["label_id"]: r["auc"] for r in evaluate.auc_by_class(df).collect()}
    for k in range(3):
        want = brute_auc([y for y, _ in rows], [p[k] for _, p in rows], k)
        assert got[k] == (None if want is None else pytest.approx(want))
    summary = evaluate.auc_summary(evaluate.auc_by_class(df)).first()
    assert (summary["auc_roc_macro"] is None) == (classes == [0, 1])


def test_metrics_small(spark):
    truth, perfect, wrong = [0, 1, 2, 0, 1, 2], [0, 1, 2, 0, 1, 2], [0, 1, 2, 0, 1, 1]
    df = spark.createDataFrame(list(zip(truth, perfect, wrong)), "label int, perfect int, prediction int")
    assert evaluate.overall_metrics(df, prediction="perfect").first()["f1_weighted"] == 1.0
    row = evaluate.overall_metrics(df).first()
    assert row["accuracy"] == pytest.approx(5 / 6) and row["f1_macro"] == pytest.approx((1 + 0.8 + 2 / 3) / 3)
    table = {(r["metric"], r["class"]): r["value"] for r in evaluate.metrics_table(df, probabilities=None).collect()}
    assert table[("precision", "spam")] == pytest.approx(2 / 3) and table[("recall", "phishing")] == 0.5
    assert evaluate.confusion_matrix(df).count() == 9
    assert "phishing" in evaluate.report_text(df)


def test_metrics_skip_classes_that_do_not_occur(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, prediction int")
    row = evaluate.overall_metrics(df).first()
    assert row["f1_macro"] == pytest.approx((2 / 3 + 2 / 3) / 2)
    names = {r["class"] for r in evaluate.metrics_table(df, probabilities=None).collect()}
    assert names == {None, "ham", "spam"}
    assert evaluate.overall_metrics(df.limit(0)).first()["accuracy"] == 0.0


RESPONSES = {
    '{"label": "spam", "confidence": 0.9, "reason": " r "}': ("spam", 0.9, "r"),
    'text {"label": " Phishing ", "confidence": 1} more': ("phishing", 1.0, ""),
    '{"a": {"label": "ham"}}': ("ham", 0.5, ""),
    "no json": None,
    "": None,
    None: None,
    '{"label": "junk", "confidence": 0.9}': None,
    '{"label": "ham", "confidence": null}': None,
    '{"label": "ham", "confidence": "0.9"}': ("ham", 0.9, ""),
    '{"label": "ham", "confidence": "high"}': None,
    '{"label": "ham", "confidence": "0.9d"}': None,
    '{"label": "ham", "confidence": 1.7}': ("ham", 1.0, ""),
    '{"label": "ham", "confidence": -1}': ("ham", 0.0, ""),
    '{"label": "ham", "confidence": true}': ("ham", 1.0, ""),
    '{"label": "ham", "confidence": "true"}': None,
    '{"label": "ham", "confidence": "1_0"}': ("ham", 1.0, ""),
    '{"label": "ham", "confidence": [1]}': None,
    "{'label': 'ham', 'confidence': 0.9}": None,
    '{"label": "ham", "confidence": 0.9,}': None,
    '{"label": "ham",\n "confidence": 2e-1, "reason": null}': ("ham", 0.2, "None"),
    '{"label": "ham", "confidence": "nan"}': ("ham", 1.0, ""),
}


def test_parse_response(spark):
    raws = list(RESPONSES)
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    for r in df.select("i", parse_response(F.col("raw")).alias("p")).collect():
        want = RESPONSES[raws[r["i"]]]
        p = r["p"]
        got = (p["label"], p["confidence"], p["reason"]) if p["parse_ok"] else None
        assert got == want, raws[r["i"]]


def _scored(spark, rows):
    df = spark.createDataFrame(rows, "message_id string, text string, proba array<double>")
    zero = {n: F.lit(0) for n in ("url_count", "phone_count", "exclamation_count")}
    return scoring.classify(df.withColumns(zero))


def test_arbitration(spark):
    p = [0.1, 0.7, 0.2]
    scored = _scored(
        spark,
        [("same", "ฟรี otp", p), ("other", "ฟรี otp", p), ("none", "ฟรี otp", p), ("bad", "ฟรี otp", p),
         ("edge", "x", [0.1, 0.8, 0.1]), ("below", "x", [0.1, 0.7999, 0.1001]), ("sure", "x", [0.95, 0.03, 0.02]), ("blank", " ", p)],
    )
    say = '{"label": "%s", "confidence": 0.6, "reason": "why"}'
    answers = spark.createDataFrame(
        [("same", say % "spam"), ("other", say % "phishing"), ("bad", "?"), ("edge", say % "ham"), ("below", say % "ham"),
         ("sure", say % "spam"), ("blank", say % "spam")],
        "message_id string, response string",
    )
    got = {r["message_id"]: r for r in scoring.decide(scored, answers).collect()}
    assert len(got) == 8
    assert (got["same"]["label"], got["same"]["confidence"], got["same"]["confidence_source"]) == ("spam", 0.65, "hybrid")
    assert got["same"]["keywords"] == ["ฟรี"] and got["same"]["llm_explanation"] == "why"
    assert (got["other"]["label"], got["other"]["confidence"], got["other"]["keywords"]) == ("phishing", 0.6, ["otp"])
    assert got["other"]["probabilities"].asDict() == {"ham": 0.1, "spam": 0.7, "phishing": 0.2}
    assert got["other"]["risk_level_th"] == "สูงมาก"
    for name in ("none", "bad", "edge", "sure"):
        assert got[name]["confidence_source"] == "ml" and got[name]["llm_explanation"] is None
    assert got["below"]["label"] == "ham"
    blank = got["blank"]
    assert (blank["label"], blank["confidence"], blank["explanation"], blank["keywords"]) == ("ham", 1.0, fixed.EXPLAIN_BLANK, [])
    asked = {r["message_id"] for r in scoring.second_opinion_requests(scored).collect()}
    assert asked == {"same", "other", "none", "bad", "below"}


def test_argmax_takes_the_lowest_index(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.2, 0.4, 0.4],)], "p array<double>")
    assert [r[0] for r in df.select(lb.argmax(F.col("p"))).collect()] == [0, 1]


def test_explanations(spark):
    text = "กดลิงก์ ฟรี รางวัล ด่วน ลดราคา เงินสด OTP"
    rows = [(text, 0), (text, 1), (text, 2), ("nothing", 1), ("nothing", 2)]
    df = spark.createDataFrame(rows, "text string, l int").withColumns(
        {"message_id": F.lit("m"), "url_count": F.lit(1), "phone_count": F.lit(0), "exclamation_count": F.lit(3),
         "proba": F.array(*[(F.col("l") == k).cast("double") for k in range(3)])}
    )
    got = scoring.decide(scoring.classify(df)).select("explanation", "keywords").collect()
    assert got[0] == (fixed.EXPLAIN_HAM, [fixed.REASON_URL, fixed.REASON_EXCLAMATION])
    words = ["รางวัล", "ฟรี", "ด่วน", "กด", "ลิงก์"]
    assert got[1][0] == "พบคำเสี่ยง: " + ", ".join(words) + " | พบลิงก์ URL | " + fixed.REASON_EXCLAMATION
    assert got[1][1] == words + ["ลดราคา", "เงินสด", fixed.REASON_URL]
    assert got[2][0].startswith("พบคำที่ใช้หลอกลวง: otp | ")
    assert got[3][0] == fixed.REASON_URL + " | " + fixed.REASON_EXCLAMATION


def test_reply_text(spark):
    df = spark.createDataFrame(
        [("spam", 0.985, "why", ["a", "b"], "because"), ("phishing", 0.5, "why", [], None), ("ham", 0.125, "fine", ["k"], "")],
        "label string, c double, e string, k array<string>, s string",
    )
    reply = format_reply(F.col("label"), F.col("c"), F.col("e"), F.col("k"), F.col("s"), F.lit("ข้อความปกติ"), F.lit("ต่ำ"))
    got = [r[0].split("\n") for r in df.select(reply).collect()]
    assert "98%" in got[0][0] and got[0][1:8] == ["", "why", "", "because", "", "คำที่น่าสงสัย: a, b", ""]
    assert len(got[1]) == 6 and "50%" in got[1][0]
    assert got[2] == ["ผลวิเคราะห์: ข้อความปกติ | ความเสี่ยง: ต่ำ (12%)", "", "fine", "", "คำเตือน: k"]


def test_faq(spark):
    questions = ["What is SPAM?", "OTP คือ", "โอนเงินไปแล้ว ฟิชชิ่ง", "hello", "ช่วยแจ้งความ"]
    df = spark.createDataFrame([(q,) for q in questions], "q string")
    got = [r[0] for r in df.select(faq_answer(F.col("q"))).collect()]
    want = ["สแปมคืออะไร", "otp คืออะไร", "ฟิชชิ่งคืออะไร", None, "ถูกหลอกแล้วทำอย่างไร"]
    assert got == [fixed.FAQ_ANSWERS.get(w) for w in want]


def test_chat_answers(spark):
    df = spark.createDataFrame([("1", "spam?"), ("2", "spam?"), ("3", "hello")], "message_id string, text string")
    replies = spark.createDataFrame([("1", "from model")], "message_id string, reply string")
    got = {r["message_id"]: (r["source"], r["reply"]) for r in chat.answers(df, replies).collect()}
    assert got["1"] == ("llm", "from model") and got["2"][0] == "faq" and got["3"] == ("fallback", fixed.CHAT_FALLBACK)
    assert {r["source"] for r in chat.answers(df).collect()} == {"faq", "fallback"}


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_history_with_one_hot_conversation(spark, block):
    turns = [(0, t * 2 + 5) for t in range(250)]  # a third of all rows, numbers with gaps
    turns += [(c, t) for c, n in enumerate([1, 9, 10, 11, 25], start=1) for t in range(n)]
    turns += [(c, 0) for c in range(10, 400)]
    turns += [(500, 1), (500, 1000), (500, 1001)]
    df = spark.createDataFrame([(c, t, "user", f"{c}/{t}") for c, t in turns], "conv_id long, turn long, role string, text string")
    got = chat.history(df, block=block).collect()
    assert len(got) == len(turns)
    by_conv = {}
    for c, t in sorted(turns):
        by_conv.setdefault(c, []).append(t)
    for r in got:
        before = [f"{r['conv_id']}/{t}" for t in by_conv[r["conv_id"]] if t < r["turn"]][-10:]
        assert [h["content"] for h in r["history"]] == before


def test_chat_messages(spark):
    history = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", str(i)) for i in range(12)], "new"), ([], "only")], f"h {history}, m string")
    got = [r[0] for r in df.select(chat.chat_messages(F.col("h"), F.col("m"))).collect()]
    assert [m["content"] for m in got[0]][1:] == [str(i) for i in range(2, 12)] + ["new"]
    assert [m["role"] for m in got[1]] == ["system", "user"]


def test_request_rules(spark):
    rows = [("ok", "u"), ("", None), ("  ", None), (None, None), ("x" * 2001, None), ("x" * 2000, "u" * 101)]
    df = spark.createDataFrame(rows, "text string, user_id string")
    got = [r[0] for r in df.select(validation.predict_rules(F.col("text"), F.col("user_id"))).collect()]
    assert got == [[], ["text_empty"], ["text_blank"], ["text_missing"], ["text_too_long"], ["user_id_too_long"]]
    feedback = spark.createDataFrame([("a", "ham", "spam"), ("a", "ham", "x"), (" ", None, "ham")], "t string, p string, a string")
    got = [r[0] for r in feedback.select(validation.feedback_rules(F.col("t"), F.col("p"), F.col("a"))).collect()]
    assert got == [[], ["actual_label_invalid"], ["predicted_label_invalid"]]
    chats = spark.createDataFrame(
        [("hi", [("user", "x")]), ("hi", [("user", "")]), ("hi", []), ("\n", [("user", "y" * 4001)])],
        "m string, h array<struct<role:string,content:string>>",
    )
    got = [r[0] for r in chats.select(validation.chat_rules(F.col("m"), F.col("h"))).collect()]
    assert got == [[], ["history_invalid"], [], ["message_blank", "history_invalid"]]


def test_generated_messages(spark):
    made = augment.generate_corpus(spark, 100, 80, 60)
    rows = made.collect()
    counts = {n: sum(r["label_name"] == n for r in rows) for n in fixed.LABELS}
    assert counts == {"ham": 100, "spam": 80, "phishing": 60}
    assert all(r["text"].strip() and "{" not in r["text"] for r in rows)
    assert len({r["message_id"] for r in rows}) == 240
    again = augment.generate_corpus(spark, 100, 80, 60).repartition(7).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(augment.generate_corpus(spark, 100, 80, 60, seed=1).collect()) != sorted(rows)


def test_unknown_template_name(spark):
    df = spark.createDataFrame([("a {x} b",), ("a {y} {x}",), ("plain",)], "t string")
    got = [r[0] for r in df.select(augment.fill_template(F.col("t"), {"x": F.lit("1")})).collect()]
    assert got == ["a 1 b", "a {y} {x}", "plain"]


def test_stats(spark):
    predictions = spark.createDataFrame([("spam",), ("ham",), ("phishing",)], "label string")
    feedback = spark.createDataFrame([(1,), (2,)], "x int")
    row = stats.prediction_stats(predictions, feedback).first()
    assert (row["total_predictions"], row["spam_rate"], row["feedback_count"]) == (3, 0.3333, 2)
    empty = stats.prediction_stats(predictions.limit(0), feedback.limit(0)).first()
    assert (empty["total_predictions"], empty["spam_rate"], empty["feedback_count"]) == (0, 0.0, 0)
    none = stats.model_info(spark.createDataFrame([], schemas.MODEL_RUNS)).first()
    assert (none["model_loaded"], none["trained_at"], none["val_accuracy"]) == (False, "unknown", 0.0)
    health = stats.health(spark.createDataFrame([], schemas.MODEL_RUNS), "2.0").first()
    assert (health["status"], health["model_loaded"], health["model_version"]) == ("ok", False, "2.0")


def test_feedback_receipts(spark):
    given = spark.createDataFrame([("t", "ham", "spam")], "text string, predicted_label string, actual_label string")
    logged = logs.feedback_log(given)
    receipt = logs.feedback_receipts(logged).first()
    assert len(receipt["feedback_id"]) == 32 and receipt["message"] == fixed.FEEDBACK_THANKS
