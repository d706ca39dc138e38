"""Text functions against plain Python on literals and random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions import text as tx
from msgsieve.operators.prepare import add_signals, prepare, signal_columns

URL = re.compile(r"(?:https?://|www\.)\S+|[a-z0-9][-a-z0-9]*\.[a-z]{2,}(?:/\S*)?", re.I)
PHONE = re.compile(r"(?:\+66|0)[0-9]{8,9}|0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|1[0-9]{3,4}")


def py_clean(text, keep=True):
    text = PHONE.sub(" PHONE " if keep else " ", URL.sub(" URL " if keep else " ", text)).lower()
    return " ".join(re.sub(r"[^฀-๿a-zA-Z0-9.,!?%]", " ", text).split())


def py_signals(text):
    words = len(text.split())
    return {
        "text_length": len(text),
        "word_count": words,
        "url_count": len(URL.findall(text)),
        "phone_count": len(PHONE.findall(text)),
        "exclamation_count": text.count("!"),
        "number_ratio": len(re.findall(r"\d+", text)) / max(words, 1),
        "caps_ratio": sum(ch.isupper() for ch in text) / max(len(text), 1),
    }


def texts():
    rng = random.Random(7)
    literals = [
        "กด https://bit.ly/fake เพื่อรับรางวัล", "โทร 062-345-6789 ทันที", "", "สวัสดี", "ยินดีด้วย! คุณได้รับรางวัล! ด่วน!",
        "กด https://example.com และ http://other.net เพื่อรับรางวัล", "OTP 123456", "100000", "end.Start", "๑๒๓ ４５",
        "a b　c\x1cd\x85e", "€5 £6 naïve 😀!", "WWW.X", "-abc.com1.org", "a" * 3000 + "." , "x-" * 500 + "y.co/z",
    ]
    alphabets = [
        "aZ09.-/:+16k KſİıwWhHtTpPsS!éกั_ 　 ​\x1c\x1f\x85😀１๑ÀΣς", "a.-b1/", "01+6-2 ",
        ["http", "https://", "www.", "a.co", "x", "://", " ", "/", "a.b.cc", "-"],
    ]
    made = ["".join(rng.choices(a, k=rng.randint(0, 30))) for a in alphabets for _ in range(1500)]
    return literals + made


@pytest.fixture(scope="module")
def computed(spark):
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "i int, text string")
    text = F.col("text")
    rows = df.select(
        "i",
        tx.clean(text).alias("clean"),
        tx.clean(text, keep_signals=False).alias("bare"),
        tx.has_content(text).alias("content"),
        tx.is_blank(text).alias("blank"),
        tx.strip(text).alias("strip"),
        tx.word_tokens(text).alias("tokens"),
        F.struct(*[v.alias(n) for n, v in tx.signals(text).items()]).alias("signals"),
    ).collect()
    return [(all_texts[r["i"]], r) for r in rows]


def test_signals(computed):
    for text, row in computed:
        got = row["signals"].asDict()
        assert {k: pytest.approx(v) for k, v in py_signals(text).items()} == got, repr(text)


def test_clean(computed):
    for text, row in computed:
        assert row["clean"] == py_clean(text), repr(text)
        assert row["bare"] == py_clean(text, keep=False), repr(text)
        assert row["content"] == (py_clean(text) != "")


def test_white_space_and_tokens(computed):
    for text, row in computed:
        assert row["blank"] == (text.strip() == "")
        assert row["strip"] == text.strip()
        assert row["tokens"] == re.findall(r"(?u)\b\w+\b", text.lower())


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = add_signals(df).withColumn("c", tx.clean(F.col("text"))).first()
    assert row["c"] == "" and [row[n] for n in fixed.SIGNALS] == [0] * 7


def test_long_run_without_dot_is_linear(spark):
    df = spark.createDataFrame([("ab1" * 200_000,)], "text string")
    assert df.select(tx.signals(F.col("text"))["url_count"]).first()[0] == 0


def test_stopwords_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("a The b a the c",)], "t string")
    assert df.select(tx.tokenize(F.col("t"), stopwords=["the"])).first()[0] == ["a", "The", "b", "a", "c"]
    assert df.select(tx.process(F.col("t"), stopwords=["the"])).first()[0] == "a b a c"


def test_callable_tokenizer(spark):
    tx.register_tokenizer("pairs", lambda: lambda s: [s[i : i + 2] for i in range(0, len(s), 2)])
    df = spark.createDataFrame([("abcde f",), (None,)], "text string")
    rows = prepare(df, tokenizer="pairs").select("text_clean").collect()
    assert [r[0] for r in rows] == ["ab cd e f"]
    with pytest.raises(ValueError):
        tx.tokenize(F.col("text"), "unknown")


def test_keyword_replacement(spark):
    df = spark.createDataFrame(
        [("You are the WINNER, get free cash now!",), ("freedom call now",), ("ที่free",), ("สวัสดีครับ",)], "t string"
    )
    got = [r[0] for r in df.select(tx.replace_keywords(F.col("t"), fixed.KEYWORD_REPLACEMENTS)).collect()]
    assert got == ["You are the ผู้ชนะ, get ฟรี เงินสด now!", "freedom โทรเดี๋ยวนี้", "ที่ฟรี", "สวัสดีครับ"]


def test_ngrams_and_counts(spark):
    df = spark.createDataFrame([("a b a b",), ("x",), ("",)], "t string")
    terms = tx.ngrams(tx.word_tokens(F.col("t")))
    rows = df.select(terms.alias("n"), tx.term_counts(terms).alias("c")).collect()
    assert rows[0]["n"] == ["a", "b", "a", "b", "a b", "b a", "a b"]
    assert [(e["term"], e["tf"]) for e in rows[0]["c"]] == [("a", 2), ("a b", 2), ("b", 2), ("b a", 1)]
    assert rows[1]["n"] == ["x"] and rows[2]["n"] == [] and rows[2]["c"] == []
    three = df.select(tx.ngrams(tx.word_tokens(F.col("t")), (2, 3))).first()[0]
    assert three == ["a b", "b a", "a b", "a b a", "b a b"]


def test_token_modes(spark):
    df = spark.createDataFrame([("ที่นี่",)], "t string")
    assert df.select(tx.word_tokens(F.col("t"), "marks")).first()[0] == ["ที่นี่"]
    assert len(df.select(tx.word_tokens(F.col("t"))).first()[0]) > 1


def test_prepare(spark, sample):
    rows = prepare(sample).collect()
    assert [r["label"] for r in sorted(rows, key=lambda r: r["message_id"])] == [0, 1, 2, 0, 1, 2]
    blank = spark.createDataFrame([(" -*- ",), ("x",)], "text string")
    assert [r["text_clean"] for r in prepare(blank).collect()] == ["x"]


def test_missing_signals_are_zero(spark):
    df = spark.createDataFrame([(3, None)], "url_count int, phone_count int")
    assert list(df.select(*signal_columns(df)).first()) == [0, 0, 3, 0, 0, 0, 0]


def test_many_matches_are_counted_without_listing_them(spark):
    """Words, capitals and kept runs of odd texts; no expression makes a string of each."""
    texts = ["", " ", " a", " a  b ", "\x1cA\x1d", "ÀÉ", "ABC", "x" * 9, "aก ่!", "\U00010400 É z", "--", "-a-", "a-", None, "İK", "é É\n\tU "]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    values = tx.signals(F.col("text"))
    found = table.select("id", values["word_count"].alias("words"), values["caps_ratio"].alias("caps"), tx.clean(F.col("text")).alias("clean"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    every = lambda text, pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    listed = table.select(
        "id", F.size(every(F.col("text"), rf"{tx.NWS}+")).alias("words"),
        (F.size(every(F.col("text"), r"\p{IsUppercase}")) / F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))).alias("caps"),
        F.array_join(every(F.lower("text"), r"[\p{Alnum}\p{InThai}.,!?%]+"), " ").alias("clean"))
    assert sorted(found.collect()) == sorted(listed.collect())
