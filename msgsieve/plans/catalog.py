"""The registered queries: every operator over whole tables.

Each query takes ``(spark, folder)`` with one Parquet file per table.  Floating
point results are rounded to six digits so that engines can be compared.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from msgsieve import fixed_values as fixed
from msgsieve.functions import explain as ex
from msgsieve.functions import labels as lb
from msgsieve.functions import responses as rs
from msgsieve.functions import text as tx
from msgsieve.functions import validation
from msgsieve.functions.evaluation import computed_once
from msgsieve.functions.replies import faq_topic
from msgsieve.operators import (
    augment, chat, dedup, evaluate, features, learners, ordered, profile, quality, regression, scoring, split, stats,
)
from msgsieve.operators.prepare import add_signals, prepare, signal_values
from msgsieve.plans import assess, ingest, score, train
from msgsieve.session import cut_lineage, new_table_path
from msgsieve.sources import corpora, logs, schemas
from msgsieve.sources.webhooks import text_events
from msgsieve.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries: the tables hold Latin text, so do these lists.
REPLACEMENTS = {"the": "THE1", "with": "avec$2", "und": "&", "la": "LA1"}
STOPWORDS = ["the", "and", "la", "de", "en", "und", "que"]
SPAM_WORDS = ["tion", "With", "eaux", "keit", "ando", "ing", "ers"]
PHISHING_WORDS = ["Que", "ung", "ch", "the", "ou", "on", "re", "ent", "an", "en"]
FAQ_WORDS = [("whith", "loans"), ("eaux", "prizes"), ("Keit", "links"), ("tion", "codes"), ("que", "calls")]
FAQ_TEXTS = {topic: f"About {topic}." for _, topic in FAQ_WORDS}
COEFFICIENTS = [
    {"text_length": 0.4, "word_count": -0.3},
    {"url_count": 0.8, "exclamation_count": 0.6, "caps_ratio": 0.4},
    {"phone_count": 0.9, "number_ratio": 0.7, "url_count": 0.3},
]
INTERCEPTS = [0.9, 0.2, -0.1]
WEBHOOK_INTERCEPTS = [0.2, 0.3, 0.1]  # turns are shorter than documents; this makes many risky
SECOND_COEFFICIENTS = [
    {"number_ratio": -0.5, "caps_ratio": 0.2},
    {"text_length": 0.3, "url_count": 0.5},
    {"word_count": 0.2, "phone_count": 0.6},
]
SECOND_INTERCEPTS = [0.4, 0.1, 0.3]
TFIDF = features.TfidfSettings()


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(value) -> Column:
    return F.round(value, 6)


# --- tables -------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents", *(columns or ("doc_id", "text", "lang", "source")))


def class_of(quality_column: str = "quality", toxic: str = "toxic") -> Column:
    """Three classes from the label table: toxic 2, else low quality 1, else 0."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality_column) == 0, 1).otherwise(0)


def labelled(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    classes = table(spark, folder, "labels", "doc_id", "quality", "toxic").select("doc_id", class_of().alias("label"))
    return documents(spark, folder, *(columns or ("doc_id", "text", "lang", "source"))).join(classes, "doc_id")


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents in the raw message schema."""
    return labelled(spark, folder).select(
        F.col("doc_id").cast("string").alias("message_id"),
        "text",
        "label",
        lb.label_name(F.col("label")).alias("label_name"),
        "source",
        F.lit("2024-01-01 00:00:00").alias("created_at"),
    )


def moments_of(prepared: DataFrame) -> dict:
    """Mean and deviation of each signal, one row per signal."""
    return {r["signal"]: r for r in features.signal_statistics(prepared).collect()}


def linear_scorer(moments: dict, coefficients=COEFFICIENTS, intercepts=INTERCEPTS) -> Callable[[DataFrame], DataFrame]:
    """Scorer with fixed coefficients on signals scaled by the corpus statistics."""

    def apply(df: DataFrame) -> DataFrame:
        scaled = {
            n: features.scale(F.col(n).cast("double"), F.lit(moments[n]["mean"]), F.lit(moments[n]["std"]))
            for n in fixed.SIGNALS
        }
        return df.withColumn("proba", scoring.linear_probabilities(scaled, coefficients, intercepts))

    return apply


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages to score, each sent by a user."""
    return documents(spark, folder, "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("message_id"),
        "text",
        F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("user_id"),
    )


def linearly_scored(df: DataFrame) -> DataFrame:
    """Signals and linear probabilities; the signals are computed once per row."""
    return linear_scorer(moments_of(add_signals(df)))(computed_once(df, signal_values()))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.classify(linearly_scored(messages(spark, folder)))


def records(spark: SparkSession, folder: str, answers: DataFrame | None = None) -> DataFrame:
    scored = classified(spark, folder)
    if answers is not None:
        scored = cut_lineage(scored, "classified")
    return scoring.decide(scored, answers, spam_keywords=SPAM_WORDS, phishing_keywords=PHISHING_WORDS)


def answer_to(doc: Column) -> Column:
    """An answer of one of many shapes, derived from a document's id."""
    confidence = F.concat(F.lit("0."), F.lpad((doc % 100).cast("string"), 2, "0"))
    name = lb.by_label_id((doc % 3).cast("int"), fixed.LABELS)
    shapes = [
        F.format_string('{"label": "%s", "confidence": %s, "reason": "r%d"}', name, confidence, doc),
        F.format_string('Sure:\n{"label": " PHISHING ", "confidence": 1.7}. {"label": "ham"}'),
        F.format_string('{"label": "%s", "confidence": "%s", "reason": " x "}', name, confidence),
        F.lit("no answer"),
        F.format_string('{"label": "unknown", "confidence": %s}', confidence),
        F.lit('{"label": "ham", "confidence": null}'),
        F.lit('{"label": "spam", "confidence": "high"}'),
        F.format_string('{"label": "%s", "reason": "a %d"}', name, doc),
        F.lit('{"label": "spam", "confidence": 0.5'),
        F.lit('{"a": {"label": "ham", "confidence": -3, "reason": "inner"}}'),
    ]
    response = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        response = F.when(doc % len(shapes) == k, shape).otherwise(response)
    return response


def second_opinions(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per document."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents", "doc_id").select(
        doc.cast("string").alias("message_id"), answer_to(doc).alias("response")
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the linear model's prediction; all documents give the moments."""
    scorer = linear_scorer(moments_of(add_signals(documents(spark, folder, "doc_id", "text"))))
    known = labelled(spark, folder, "doc_id", "text")
    scored = scoring.classify(scorer(computed_once(known, signal_values())))
    return scored.select("doc_id", "proba", F.col("ml_label_id").alias("prediction"), "label")


def event_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a prediction log."""
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").select(
        F.col("event_id").cast("string").alias("id"),
        _event_label().alias("label"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("created_at"),
    )


# --- text ---------------------------------------------------------------------


@query
def signals(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    values = tx.signals(F.col("text"))
    return docs.select(
        "doc_id", *[(r6(v) if n.endswith("_ratio") else v).alias(n) for n, v in values.items()]
    )


@query
def clean_text(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select(
        "doc_id",
        tx.clean(F.col("text")).alias("text_clean"),
        F.md5(tx.clean(F.col("text"), keep_signals=False)).alias("without_marks"),
    )


@query
def processed_text(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", tx.process(F.col("text"), stopwords=STOPWORDS).alias("text_processed"))


@query
def prepared_messages(spark, folder):
    """Turns, pages, pages' addresses and documents prepared together; blank ones drop out."""
    parts = [
        documents(spark, folder, "doc_id", "text").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"),
        table(spark, folder, "pages", "page_id", "url").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("text")),
        table(spark, folder, "pages", "page_id", "html").select(F.concat(F.lit("h"), "page_id").alias("id"), F.col("html").alias("text")),
        table(spark, folder, "conversations", "conv_id", "turn", "text").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"),
        # a blank and a missing text for every turn of a system
        table(spark, folder, "conversations", "conv_id", "turn", "role").where(F.col("role") == "system").select(
            F.concat_ws("-", F.lit("s"), "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 2 == 0, " -*- ").alias("text")),
    ]
    merged = functools.reduce(DataFrame.unionByName, parts)
    return prepare(merged).select(
        "id", "text_clean", "text_length", "word_count", "url_count", "phone_count", "exclamation_count",
        r6("number_ratio").alias("number_ratio"), r6("caps_ratio").alias("caps_ratio"),
    )


@query
def keyword_replacement(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", tx.replace_keywords(F.col("text"), REPLACEMENTS).alias("text"))


@query
def url_signals_of_pages(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "html")
    values = tx.signals(F.col("html"))
    return pages.select("page_id", *[(r6(v) if n.endswith("_ratio") else v).alias(n) for n, v in values.items()])


@query
def term_statistics(spark, folder):
    return features.term_statistics(prepare(documents(spark, folder, "doc_id", "text")), TFIDF)


# --- ingest and quality -------------------------------------------------------


@query
def merged_corpus(spark, folder):
    """Union of three corpora, normalised and without duplicate texts."""
    docs = labelled(spark, folder, "doc_id", "text").select(
        lb.label_name(F.col("label")).alias("label_name"), "text", F.col("doc_id").alias("ordinal")
    )
    bench = table(spark, folder, "benchmark", "item_id", "text").select(
        F.lit("ham").alias("label_name"), "text", F.col("item_id").alias("ordinal")
    )
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        F.when(F.col("role") == "user", "spam").when(F.col("role") == "assistant", "ham").otherwise("other").alias("label_name"),
        "text",
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ordinal"),
    )
    mapping = {name: i for i, name in enumerate(fixed.LABELS)}

    return ingest.merge(
        *[
            corpora.normalise_corpus(rows, source, mapping, {}, F.col("ordinal"))
            for rows, source in ((docs, "documents"), (bench, "benchmark"), (turns, "conversations"))
        ]
    )


@query
def label_distribution(spark, folder):
    counts = quality.label_distribution(raw_messages(spark, folder))
    return counts.select("label", "n", r6("share").alias("share"))


@query
def duplicate_texts(spark, folder):
    return dedup.duplicate_count(documents(spark, folder, "text"))


def _flat_report(report: DataFrame) -> DataFrame:
    return report.select(
        "passed",
        "n_rows",
        *[F.coalesce(F.col("label_distribution")[k], F.lit(0)).alias(f"label_{k}") for k in range(3)],
        F.array_join("issues", "; ").alias("issues"),
        F.inline(F.transform(F.map_entries("stats"), lambda e: F.struct(e["key"].alias("stat"), F.round(e["value"], 6).alias("value")))),
    )


@query
def raw_report(spark, folder):
    return _flat_report(quality.raw_report(raw_messages(spark, folder)))


@query
def dominated_report(spark, folder):
    """Classes of which one holds most rows, so that the report names it."""
    toxic = F.when(F.col("toxic") == 0, 0).otherwise(F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1))
    classes = table(spark, folder, "labels", "doc_id", "toxic").select("doc_id", toxic.alias("label"))
    docs = documents(spark, folder).join(classes, "doc_id").select(
        F.col("doc_id").cast("string").alias("message_id"), "text", "label",
        lb.label_name(F.col("label")).alias("label_name"), "source", F.lit("2024-01-01 00:00:00").alias("created_at"))
    return _flat_report(quality.raw_report(docs))


@query
def raw_violations(spark, folder):
    broken = quality.violations(raw_messages(spark, folder), quality.raw_rules())
    return broken.select("message_id", F.array_join("broken_rules", ",").alias("broken_rules"))


@query
def raw_rule_counts(spark, folder):
    return quality.rule_counts(raw_messages(spark, folder), quality.raw_rules())


@query
def processed_report(spark, folder):
    return _flat_report(quality.processed_report(prepare(raw_messages(spark, folder))))


@query
def split_by_hash(spark, folder):
    return split.split_by_hash(documents(spark, folder, "doc_id", "text")).select("doc_id", "split")


@query
def split_exact(spark, folder):
    return split.split_exact(table(spark, folder, "documents", "doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query
def split_table(spark, folder):
    """Written splits, read back with partition pruning."""
    path = new_table_path(spark, "splits")
    rows = split.split_by_hash(raw_messages(spark, folder))
    corpora.write_splits(rows, path)
    with_split = T.StructType([*schemas.RAW.fields, T.StructField("split", T.StringType())])
    written = spark.read.schema(with_split).parquet(path)
    return written.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def split_checks(spark, folder):
    """Rows, ids and texts per split of the exact split, and how many ids lie in two."""
    rows = split.split_exact(raw_messages(spark, folder))
    per_id = rows.groupBy("message_id").agg(F.count_distinct("split").alias("splits"), F.min("split").alias("split"), F.min("label").alias("label"))
    return per_id.groupBy("split", "label").agg(F.count("*").alias("n"), F.count_if(F.col("splits") > 1).alias("n_shared"))


@query
def tsv_corpus(spark, folder):
    """Labelled documents written as TSV with quoted fields, read and normalised; a missing corpus adds nothing."""
    path = new_table_path(spark, "corpus-tsv")
    rows = raw_messages(spark, folder).select("label_name", "text")
    rows.write.options(sep="\t", quote='"', escape='"', quoteAll="true", encoding="UTF-8").csv(path)
    read = corpora.load_tsv_corpus(spark, path)
    missing = corpora.load_tsv_corpus(spark, f"{path}-missing")
    merged = corpora.union_corpora(missing, read)
    return merged.select("label", "label_name", "source", "priority", F.md5("text").alias("text_md5"))


@query
def csv_corpus(spark, folder):
    """The raw messages written as CSV and read again, with and without multi-line fields."""
    path = new_table_path(spark, "corpus-csv")
    rows = raw_messages(spark, folder)
    corpora.write_corpus(rows, f"{path}/multi")
    flat = rows.withColumn("text", F.translate("text", "\n", " "))
    corpora.write_corpus(flat, f"{path}/single")
    both = corpora.load_csv_corpus(spark, f"{path}/multi").withColumn("form", F.lit("multi")).unionByName(
        corpora.load_csv_corpus(spark, f"{path}/single", multi_line=False).withColumn("form", F.lit("single")))
    return both.select("form", "message_id", "label", "label_name", "source", "created_at", F.md5("text").alias("text_md5"))


# --- exploration --------------------------------------------------------------


@query
def describe_lengths(spark, folder):
    docs = prepare(documents(spark, folder, "doc_id", "text", "lang"))
    described = ordered.describe(docs, "lang", ["text_length", "word_count"], digits=6)
    return described


@query
def length_histogram(spark, folder):
    docs = documents(spark, folder, "text", "lang").withColumn("text_length", F.length("text"))
    return profile.histogram(docs, "lang", "text_length", 30)


@query
def word_histogram(spark, folder):
    docs = documents(spark, folder, "text", "lang").withColumn("word_count", tx.signals(F.col("text"))["word_count"])
    return profile.histogram(docs, "lang", "word_count", 20)


@query
def signal_means(spark, folder):
    docs = prepare(documents(spark, folder, "text", "lang"))
    return profile.signal_means(docs, "lang", fixed.SIGNALS, digits=4)


@query
def sample_per_class(spark, folder):
    return profile.sample_per_class(table(spark, folder, "documents", "doc_id", "text", "lang"), "lang", "doc_id")


@query
def shuffled_order(spark, folder):
    return profile.shuffled(table(spark, folder, "documents", "doc_id"), "doc_id")


# --- features -----------------------------------------------------------------


@query
def vocabulary(spark, folder):
    docs = cut_lineage(prepare(documents(spark, folder, "doc_id", "text")).select("text_clean"))
    terms = features.vocabulary(docs, TFIDF)
    return terms.select("term", "df", "ctf", r6("idf").alias("idf"), "idx")


@query
def tfidf_weights(spark, folder):
    docs = cut_lineage(prepare(documents(spark, folder, "doc_id", "text")).drop("text"))
    weights = features.MessageFeatures(settings=TFIDF).fit(docs).weights(docs, "doc_id")
    return weights.select("doc_id", "idx", "term", r6("weight").alias("weight"))


@query
def scaled_signals(spark, folder):
    docs = prepare(documents(spark, folder, "doc_id", "text"))
    scaled = features.scaled_signals(docs, features.signal_statistics(docs))
    return scaled.select("doc_id", *[r6(n).alias(n) for n in fixed.SIGNALS])


@query
def class_weights(spark, folder):
    weights = features.class_weights(raw_messages(spark, folder))
    return weights.select("label", "n", r6("weight").alias("weight"))


@query
def feature_names(spark, folder):
    """Terms in column order, then the signals."""
    model = features.MessageFeatures(settings=TFIDF).fit(cut_lineage(prepare(documents(spark, folder, "doc_id", "text"))))
    return spark.createDataFrame(list(enumerate(model.feature_names())), "idx int, name string")


# --- scoring ------------------------------------------------------------------


@query
def linear_scores(spark, folder):
    scored = classified(spark, folder)
    return scored.select(
        "message_id",
        *[r6(F.get("proba", F.lit(k))).alias(n) for k, n in enumerate(fixed.LABELS)],
        "ml_label_id",
        r6("ml_confidence").alias("ml_confidence"),
    )


@query
def soft_vote(spark, folder):
    prepared = prepare(documents(spark, folder, "doc_id", "text"))
    once = computed_once(prepared, {n: F.col(n) for n in fixed.SIGNALS})
    moments = moments_of(prepared)
    first = linear_scorer(moments)(once).withColumnRenamed("proba", "a")
    both = linear_scorer(moments, SECOND_COEFFICIENTS, SECOND_INTERCEPTS)(first)
    third = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    voted = both.select("doc_id", lb.soft_vote([F.col("a"), F.col("proba"), third], (2, 1, 2)).alias("p"))
    return voted.select(
        "doc_id", *[r6(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(fixed.LABELS)], lb.argmax(F.col("p")).alias("prediction")
    )


def _flat_records(rows: DataFrame) -> DataFrame:
    return rows.select(
        "message_id", "label", "label_th", "label_id", "confidence", "risk_level", "risk_level_th", "explanation",
        F.array_join("keywords", ",").alias("keywords"),
        *[F.col(f"probabilities.{n}").alias(f"p_{n}") for n in fixed.LABELS],
        "confidence_source",
        "llm_explanation",
    )


@query
def decision_records(spark, folder):
    return _flat_records(records(spark, folder))


@query
def blank_decisions(spark, folder):
    """Every fifth message is blank: a certain ham that asks for no second opinion."""
    docs = messages(spark, folder)
    scorer = linear_scorer(moments_of(add_signals(docs)))
    blanked = docs.withColumn("text", F.when(F.col("message_id").cast("bigint") % 5 == 0, " \t\n").otherwise(F.col("text")))
    classified_rows = scoring.classify(scorer(computed_once(blanked, signal_values())))
    decided = scoring.decide(classified_rows, None, spam_keywords=SPAM_WORDS, phishing_keywords=PHISHING_WORDS)
    return decided.select("message_id", "label", "confidence", "explanation", F.array_join("keywords", ",").alias("keywords"))


@query
def second_opinion_requests(spark, folder):
    asked = scoring.second_opinion_requests(classified(spark, folder))
    return asked.select(
        "message_id", F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5"),
        r6("ml_confidence").alias("ml_confidence"),
    )


@query
def parsed_responses(spark, folder):
    answers = second_opinions(spark, folder)
    return answers.select("message_id", rs.parse_response(F.col("response")).alias("p")).select("message_id", "p.*")


@query
def arbitrated_records(spark, folder):
    return _flat_records(records(spark, folder, second_opinions(spark, folder)))


@query
def explanations(spark, folder):
    """Keyword hits, reasons and explanation for the class in the label table."""
    docs = labelled(spark, folder, "doc_id", "text")
    values = tx.signals(F.col("text"))
    hits = ex.keyword_hits(F.col("text"), F.col("label"), SPAM_WORDS, PHISHING_WORDS)
    reasons = ex.signal_reasons(values["url_count"], values["phone_count"], values["exclamation_count"])
    found = docs.select("doc_id", "label", hits.alias("hits"), reasons.alias("reasons"))
    return found.select(
        "doc_id",
        F.array_join("hits", ",").alias("hits"),
        F.array_join("reasons", ",").alias("reasons"),
        ex.explanation(F.col("label"), F.col("hits"), F.col("reasons")).alias("explanation"),
        F.array_join(ex.risk_words(F.col("hits"), F.col("reasons")), ",").alias("risk_words"),
    )


@query
def reply_texts(spark, folder):
    decided = records(spark, folder, second_opinions(spark, folder))
    return score.replies(decided, "message_id")


# --- evaluation ---------------------------------------------------------------


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(judged(spark, folder))


@query
def overall_metrics(spark, folder):
    found = evaluate.overall_metrics(judged(spark, folder))
    return found.select(*[c if c == "support" else r6(c).alias(c) for c in found.columns])


@query
def class_metrics(spark, folder):
    found = evaluate.class_metrics(judged(spark, folder))
    return found.select(
        "label_id", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support", "predicted"
    )


@query
def auc_by_class(spark, folder):
    found = evaluate.auc_by_class(judged(spark, folder))
    return found.select("label_id", "positives", "negatives", r6("auc").alias("auc"))


@query
def metrics_table(spark, folder):
    # several aggregations read the scores, so they are written once
    return evaluate.metrics_table(cut_lineage(judged(spark, folder))).select("metric", "class", r6("value").alias("value"))


@query
def classification_report(spark, folder):
    found = evaluate.report_rows(judged(spark, folder))
    return found.select("position", "row", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


class _LinearModel:
    """The linear scorer in the form of a trained model."""

    def __init__(self, scorer):
        self.scorer = scorer

    def score(self, prepared: DataFrame) -> DataFrame:
        return self.scorer(prepared).withColumn("prediction", lb.argmax(F.col("proba")))


@query
def evaluation_report(spark, folder):
    """The confusion matrix and report files that an evaluation writes, read again."""
    prepared = prepare(labelled(spark, folder, "doc_id", "text"))
    model = _LinearModel(linear_scorer(moments_of(add_signals(documents(spark, folder, "doc_id", "text")))))
    path = new_table_path(spark, "evaluation")
    assess.assess(model, prepared, path)
    confusion = spark.read.schema("actual int, predicted int, n bigint").json(f"{path}/confusion")
    metrics = spark.read.parquet(f"{path}/metrics").where("class IS NULL AND metric IN ('accuracy', 'f1_weighted')")
    return confusion.select(F.concat_ws("-", F.lit("n"), "actual", "predicted").alias("name"), F.col("n").cast("double").alias("value")).unionByName(
        metrics.select(F.col("metric").alias("name"), r6("value").alias("value")))


# --- logs and statistics ------------------------------------------------------

LOGGED_AT = "2024-05-06 07:08:09"


@query
def prediction_log(spark, folder):
    """The log as written and read again."""
    path = new_table_path(spark, "predictions")
    rows = logs.prediction_log(records(spark, folder), F.lit(LOGGED_AT).cast("timestamp"))
    logs.append_batch(rows, path, "batch-job")
    logs.append_batch(rows, path, "batch-job")  # a repeated batch replaces itself
    return logs.scan_predictions(spark, path).select(
        "id", "text", "label", "label_id", "confidence", "risk_level", "user_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query
def telemetry(spark, folder):
    rows = logs.telemetry(
        records(spark, folder).withColumn("user_id", F.when(F.col("user_id") != "u0", F.col("user_id")))
    )
    return rows.select(
        "message_id",
        *[F.col("tags")[n].alias(n) for n in ("label", "risk_level", "confidence_source", "user_id", "text_preview")],
        *[F.col("metrics")[n].alias(n) for n in ("confidence", "label_id", "processing_time_ms", "prob_ham", "prob_spam", "prob_phishing")],
        *[F.col("params")[n].alias(n) for n in ("text_length", "keywords_count")],
    )


def _corrections(judgements: DataFrame) -> DataFrame:
    """The model's label against the label table, some unusable."""
    actual = F.when(F.col("doc_id") % 11 == 0, F.lit("unknown")).otherwise(lb.label_name(F.col("label")))
    return judgements.withColumns(
        {"predicted_label": lb.label_name(F.col("prediction")), "actual_label": actual}
    )


def _feedback(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return _corrections(judged(spark, folder)).select("doc_id", "predicted_label", "actual_label").join(docs, "doc_id")


@query
def feedback_quarantine(spark, folder):
    rules = validation.feedback_rules(F.col("text"), F.col("predicted_label"), F.col("actual_label"))
    return _feedback(spark, folder).select("doc_id", F.array_join(rules, ",").alias("reasons"))


@query
def feedback_log(spark, folder):
    rules = validation.feedback_rules(F.col("text"), F.col("predicted_label"), F.col("actual_label"))
    good = _feedback(spark, folder).where(F.size(rules) == 0)
    rows = logs.feedback_log(good, F.lit(LOGGED_AT).cast("timestamp"))
    return rows.select("text", "predicted_label", "actual_label")


@query
def feedback_log_scan(spark, folder):
    """The feedback log as two jobs wrote it, one of them twice, and read again."""
    rules = validation.feedback_rules(F.col("text"), F.col("predicted_label"), F.col("actual_label"))
    good = cut_lineage(_feedback(spark, folder).where(F.size(rules) == 0))
    path = new_table_path(spark, "feedback")
    for job, part in (("a", 0), ("b", 1), ("b", 1)):
        own = good.where(F.col("doc_id") % 2 == part)
        logs.append_batch(logs.feedback_log(own, F.lit(LOGGED_AT).cast("timestamp")), path, job)
    return logs.scan_feedback(spark, path).select("job", "text", "predicted_label", "actual_label")


@query
def request_quarantine(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "source").withColumn("user_id", F.repeat("source", 25))
    checked = score.check_requests(docs)
    return checked.select(
        "doc_id", F.array_join("reasons", ",").alias("reasons"), F.md5("text").alias("text_md5")
    )


@query
def chat_quarantine(spark, folder):
    turns = chat.history(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    rules = validation.chat_rules(F.col("text"), F.col("history"), limit=400, history_limit=900)
    return turns.select("conv_id", "turn", F.array_join(rules, ",").alias("reasons"))


@query
def prediction_stats(spark, folder):
    scored = cut_lineage(
        linearly_scored(documents(spark, folder, "doc_id", "text")).select(
            "doc_id", lb.argmax(F.col("proba")).alias("prediction")
        )
    )
    classes = table(spark, folder, "labels", "doc_id", "quality", "toxic").select("doc_id", class_of().alias("label"))
    feedback = _corrections(scored.join(classes, "doc_id")).where(F.col("predicted_label") != F.col("actual_label"))
    predictions = scored.select(lb.label_name(F.col("prediction")).alias("label"))
    return stats.prediction_stats(predictions, feedback)


@query
def user_counters(spark, folder):
    return stats.user_counters(event_predictions(spark, folder))


def _text_windows(found: DataFrame) -> DataFrame:
    shown = {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("period_start", "period_end")}
    return found.withColumns(shown)


@query
def windowed_stats(spark, folder):
    return _text_windows(stats.windowed_stats(event_predictions(spark, folder), "6 hours"))


def _language_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One model run per language, with the accuracy on its documents."""
    langs = table(spark, folder, "documents", "doc_id", "lang")
    judgements = cut_lineage(judged(spark, folder).join(langs, "doc_id"))
    last = judgements.groupBy("lang").agg(F.max("doc_id").alias("last"))
    per_lang = evaluate.overall_metrics_by(judgements, "lang").join(last, "lang")
    return per_lang.select(
        F.col("lang").alias("run"),
        F.lit("1.0.0").alias("version"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("last")).alias("trained_at"),
        F.col("support").alias("train_samples"),
        F.create_map(
            F.lit("val_accuracy"), F.col("accuracy"), F.lit("val_f1_weighted"), F.col("f1_weighted")
        ).alias("metrics"),
    )


@query
def model_info(spark, folder):
    found = stats.model_info(_language_runs(spark, folder))
    return found.withColumns({"val_accuracy": r6("val_accuracy"), "label_names": F.array_join("label_names", ",")})


@query
def model_comparison(spark, folder):
    """Run rows appended to the model table one by one, read back and compared."""
    runs, path = cut_lineage(_language_runs(spark, folder), "runs"), new_table_path(spark, "model-runs")
    for row in runs.select("run").collect():  # one per language
        own = runs.where(F.col("run") == row["run"])
        rows = own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MODEL_RUNS])
        logs.append_model_run(rows, path, row["run"], f"{path}-json/{row['run']}")
    found = stats.model_comparison(logs.scan_model_runs(spark, path))
    return found.select("model", *[r6(c).alias(c) for c in ("accuracy", "f1_weighted", "auc_roc", "train_seconds")])


# --- conversations and webhooks -----------------------------------------------


def _joined_history(history: Column) -> Column:
    return F.md5(F.array_join(F.transform(history, lambda h: F.concat_ws(":", h["role"], h["content"])), "|"))


@query
def chat_context(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    found = chat.history(turns, limit=3, block=2)
    return found.select("conv_id", "turn", F.size("history").alias("n"), _joined_history(F.col("history")).alias("history_md5"))


@query
def chat_messages(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    asked = chat.history(turns).where(F.col("role") == "user")
    built = chat.chat_messages(F.col("history"), F.col("text"), "Be kind.")
    return asked.select("conv_id", "turn", F.size(built).alias("n"), _joined_history(built).alias("messages_md5"))


@query
def faq_topics(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", faq_topic(F.col("text"), [(w.lower(), t) for w, t in FAQ_WORDS]).alias("topic"))


@query
def chat_answers(spark, folder):
    """Model reply when there is one (the next turn), else a listed or fixed answer."""
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    key = F.concat_ws("-", "conv_id", "turn")
    asked = turns.where(F.col("role") == "user").select(key.alias("message_id"), "text")
    told = turns.where(F.col("role") == "assistant").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("message_id"), F.col("text").alias("reply")
    )
    return chat.answers(asked, told).select("message_id", "source", F.md5("reply").alias("reply_md5"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Webhook bodies: a text or sticker message and a follow event per turn."""
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    token = F.concat_ws("-", F.lit("t"), "conv_id", "turn")
    user = F.struct(F.concat(F.lit("u"), "conv_id").alias("userId"))
    content = F.struct(F.when(F.col("role") == "user", "text").otherwise("sticker").alias("type"), F.col("text").alias("text"))
    message = F.struct(F.lit("message").alias("type"), token.alias("replyToken"), user.alias("source"), content.alias("message"))
    nothing = F.lit(None).cast("struct<type:string,text:string>")
    follow = F.struct(F.lit("follow").alias("type"), F.lit("x").alias("replyToken"), user.alias("source"), nothing.alias("message"))
    events = F.when(F.col("role") == "system", F.slice(F.array(message), 1, 0)).otherwise(F.array(follow, message))
    return turns.select(F.to_json(F.struct(F.lit("d").alias("destination"), events.alias("events"))).alias("body"))


@query
def webhook_events(spark, folder):
    return text_events(_bodies(spark, folder)).select("position", "reply_token", "user_id", "text", "message_id")


@query
def webhook_replies(spark, folder):
    """Replies to risky events, scored with coefficients fitted to documents."""
    moments = moments_of(prepare(documents(spark, folder, "doc_id", "text")))
    scorer = linear_scorer(moments, COEFFICIENTS, WEBHOOK_INTERCEPTS)
    return jobs.webhook_replies(text_events(_bodies(spark, folder)), scorer)


# --- generated messages -------------------------------------------------------


@query
def generated_messages(spark, folder):
    """One generated message of the same class per labelled document."""
    classes = table(spark, folder, "labels", "doc_id", "quality", "toxic").select("doc_id", class_of().alias("label"))
    return augment.messages_for(classes, "doc_id")


# --- streams ------------------------------------------------------------------


def _table_stream(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A stream over the files of a table: those in its folder, or the one file that it is."""
    schema = table(spark, folder, name, *columns).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return jobs.file_stream(spark, f"{folder}/{name}.parquet", schema)
    return jobs.file_stream(spark, folder, schema, pathGlobFilter=f"{name}.parquet")


@query
def stream_scoring(spark, folder):
    """Requests scored as a stream; the log equals the batch result."""
    out = new_table_path(spark, "stream-scoring")
    stream = _table_stream(spark, folder, "documents", "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("message_id"), "text"
    )
    scorer = linear_scorer(moments_of(add_signals(documents(spark, folder, "doc_id", "text"))))
    jobs.run_available(jobs.score_stream(stream, scorer, out, f"{out}/checkpoint"))
    return logs.scan_predictions(spark, f"{out}/predictions").select(
        "id", "label", "label_id", "confidence", "risk_level", F.md5("text").alias("text_md5")
    )


def _sent_at(doc: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_700_000_000) + doc)


@query
def stream_arbitration(spark, folder):
    """Unsure messages wait an hour for answers that take up to two; later ones do not count.

    One row with a far later time at the end of each stream closes all that waits.
    """
    out = new_table_path(spark, "stream-arbitration")
    doc = F.col("doc_id")
    took = F.make_dt_interval(mins=(doc % 7).cast("int") * 20)
    sent = _table_stream(spark, folder, "documents", "doc_id", "text").select(
        doc.cast("string").alias("message_id"), "text", _sent_at(doc).alias("created_at")
    )
    answered = _table_stream(spark, folder, "documents", "doc_id").select(
        doc.cast("string").alias("message_id"), answer_to(doc).alias("response"), (_sent_at(doc) + took).alias("answered_at")
    )
    far = F.lit("2200-01-01").cast("timestamp")
    valid = F.lit('{"label": "ham", "confidence": 1}')
    end = spark.range(1).select(F.lit("end").alias("message_id"), F.lit("").alias("text"), far.alias("created_at"), valid.alias("response"), far.alias("answered_at"))
    end.write.parquet(f"{out}/end")
    last = jobs.file_stream(spark, f"{out}/end", end.schema)
    scorer = linear_scorer(moments_of(add_signals(documents(spark, folder, "doc_id", "text"))))
    with jobs.state_on_disk(spark):
        jobs.run_available(
            jobs.arbitrate_stream(
                sent.unionByName(last.select(*sent.columns)), answered.unionByName(last.select(*answered.columns)),
                scorer, out, f"{out}/checkpoint", spam_keywords=SPAM_WORDS, phishing_keywords=PHISHING_WORDS,
            )
        )
    found = spark.read.parquet(f"{out}/records/job=*/batch=*")
    return _flat_records(found.where(F.col("message_id") != "end"))


@query
def stream_feedback(spark, folder):
    """Feedback checked and logged as a stream, in several batches."""
    out = new_table_path(spark, "stream-feedback")
    rows = _feedback(spark, folder).select("text", "predicted_label", "actual_label")
    rows.repartition(3, "text").write.parquet(f"{out}/in")
    stream = jobs.file_stream(spark, f"{out}/in", rows.schema, maxFilesPerTrigger=1)
    jobs.run_available(jobs.feedback_stream(stream, out, f"{out}/checkpoint"))
    return logs.scan_feedback(spark, f"{out}/feedback").select("text", "predicted_label", "actual_label")


@query
def stream_webhook(spark, folder):
    """Webhook bodies answered as a stream, each delivered twice."""
    out = new_table_path(spark, "stream-webhook")
    bodies = _bodies(spark, folder)
    bodies.unionByName(bodies).write.parquet(f"{out}/in")
    moments = moments_of(prepare(documents(spark, folder, "doc_id", "text")))
    scorer = linear_scorer(moments, COEFFICIENTS, WEBHOOK_INTERCEPTS)
    stream = jobs.file_stream(spark, f"{out}/in", bodies.schema)
    jobs.run_available(jobs.webhook_stream(stream, scorer, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/replies/job=*/batch=*").select("reply_token", "user_id", "reply")


def _event_label() -> Column:
    return F.when(F.col("event_type") == "click", "spam").when(F.col("event_type") == "error", "phishing").otherwise("ham")


@query
def stream_user_counters(spark, folder):
    """Running totals per user of the events, read back after the stream has stopped."""
    out = new_table_path(spark, "stream-counters")
    stream = _table_stream(spark, folder, "events", "user_id", "event_type")
    predictions = stream.select(F.col("user_id").cast("string").alias("user_id"), _event_label().alias("label"))
    jobs.run_available(jobs.user_counter_stream(predictions, out, f"{out}/checkpoint"))
    return jobs.latest_counters(spark, out)


@query
def stream_windowed_stats(spark, folder):
    """Periods that the watermark has closed at the end of the events."""
    out = new_table_path(spark, "stream-stats")
    stream = _table_stream(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    predictions = stream.select(_event_label().alias("label"), F.col("ts").cast("timestamp").alias("created_at"))
    jobs.run_available(jobs.stats_stream(predictions, f"{out}/rows", f"{out}/checkpoint", "6 hours", "10 minutes"))
    return _text_windows(spark.read.parquet(f"{out}/rows"))


# --- learning -----------------------------------------------------------------


@query
def feature_vectors(spark, folder):
    """The stored vectors that learners read, one row per non-zero position."""
    docs = cut_lineage(prepare(documents(spark, folder, "doc_id", "text")))
    model = features.MessageFeatures(settings=TFIDF).fit(docs)
    stored = features.stored_vectors(model.structs(docs).select("doc_id", "features"), "features")
    parts = F.unwrap_udt("features")
    entries = F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("value"))
    exploded = stored.select("doc_id", F.explode(entries).alias("e"))
    return exploded.select("doc_id", F.col("e.idx").alias("idx"), r6("e.value").alias("value"))


# Learners are fitted on the whole train split.  A number here would leave them the rows with the
# smallest hashes of their ids, for a trial; no query sets it.
MOST_TRAINING_ROWS: int | None = None


def _learning_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train, the rows that learners see (all of train), validation and test messages, prepared once."""
    rows = split.split_by_hash(labelled(spark, folder, "doc_id", "text"))
    rows = cut_lineage(prepare(rows), "labelled")
    train_set, val, test = (rows.where(F.col("split") == name) for name in ("train", "val", "test"))
    fit_on = train_set if MOST_TRAINING_ROWS is None else _first_by_hash(train_set, MOST_TRAINING_ROWS)
    return train_set, fit_on, val, test


def _first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of their ids; only ids are sorted, texts stay in their tasks."""
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    first = rows.select(place.alias("place")).orderBy("place").limit(most)
    last = first.groupBy("place").count().orderBy(F.desc("place")).limit(1).first()
    if last is None:
        return rows
    cut = F.struct(F.lit(last["place"]["h"]).alias("h"), F.lit(last["place"]["doc_id"]).alias("doc_id"))
    # of copies of the last id as many as there is room for
    return rows.where(place < cut).unionByName(rows.where(place == cut).limit(last["count"]))


def _regression(spark: SparkSession, folder: str) -> tuple[train.RiskModel, DataFrame, str, tuple]:
    """A regression trained and saved, its run rows, where it was saved, and the learning sets."""
    sets = _learning_sets(spark, folder)
    path = new_table_path(spark, "model")
    model, runs = train.train(spark, sets[0], sets[2], model_path=path, names=("lr",), learn_on=sets[1])
    return model, runs, path, sets


def _three(proba: str = "proba") -> list[Column]:
    return [r6(F.get(proba, F.lit(k))).alias(name) for k, name in enumerate(fixed.LABELS)]


@query
def logistic_regression_scores(spark, folder):
    """Text features and a regression fitted on the train split, scores of all."""
    model, _, _, (train_set, _, val, test) = _regression(spark, folder)
    rows = train_set.unionByName(val).unionByName(test)
    return model.score(rows).select("doc_id", "split", "label", F.col("prediction").cast("int").alias("prediction"), *_three())


@query
def coefficient_scores(spark, folder):
    """The same scores from the saved coefficients alone: a join and a sparse dot product."""
    model, _, path, (train_set, _, val, test) = _regression(spark, folder)
    rows = train_set.unionByName(val).unionByName(test)
    vectors = features.stored_vectors(model.features.structs(rows).select("doc_id", "features"), "features")
    coefficients = spark.read.parquet(f"{path}/tables/coefficients")
    return regression.scores_by_table(vectors, coefficients, "doc_id").select("doc_id", *_three())


@query
def model_coefficients(spark, folder):
    """The table of coefficients that is saved with a model."""
    _, _, path, _ = _regression(spark, folder)
    found = spark.read.parquet(f"{path}/tables/coefficients")
    return found.select("label_id", "idx", "name", F.round("weight", 4).alias("weight"))


@query
def regression_certificate(spark, folder):
    """Objective and gradient at the saved coefficients, by joins and sums over the train vectors."""
    model, _, path, (train_set, fit_on, _, _) = _regression(spark, folder)
    vectors = features.stored_vectors(model.features.structs(fit_on).select("label", "features"), "features")
    weighted = learners.with_class_weights(vectors, of=train_set)
    found = regression.certificate(weighted, spark.read.parquet(f"{path}/tables/coefficients"))
    return found.select("numbers", r6("objective").alias("objective"), r6("gradient").alias("gradient"))


@query
def regression_runs(spark, folder):
    """The run rows of a training of the regression: sample counts and validation metrics."""
    _, runs, _, _ = _regression(spark, folder)
    metric = {"accuracy": "val_accuracy", "f1_weighted": "val_f1_weighted", "auc_roc": "val_auc_roc"}
    return runs.select(F.col("run").alias("model"), "train_samples", "val_samples",
                       *[r6(F.col("metrics")[key]).alias(name) for name, key in metric.items()])


@query
def vote_training_runs(spark, folder):
    """Run rows of the three learners and their vote, with the settings of the training job."""
    train_set, fit_on, val, _ = _learning_sets(spark, folder)
    _, runs = train.train(spark, train_set, val, learn_on=fit_on)
    return stats.model_comparison(runs)


@query
def test_set_metrics(spark, folder):
    """A regression is trained, saved, loaded and assessed on the test split."""
    _, _, path, (_, _, _, test) = _regression(spark, folder)
    found = assess.assess(train.RiskModel.load(path), test)
    return found["metrics"].select("metric", "class", r6("value").alias("value"))


@query
def decision_records_of_model(spark, folder):
    """Decision records of all documents from a trained model that was saved and loaded."""
    _, _, path, _ = _regression(spark, folder)
    return _flat_records(score.score_messages(messages(spark, folder), train.RiskModel.load(path)))
