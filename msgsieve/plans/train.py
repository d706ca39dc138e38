"""Training job: features once, each learner once, the vote from the fitted parts."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

import msgsieve
from msgsieve import fixed_values as fixed
from msgsieve.operators import evaluate, learners, regression
from msgsieve.operators.features import MessageFeatures, MessageFeaturesModel, TfidfSettings, stored_vectors
from msgsieve.operators.prepare import prepare
from msgsieve.session import cut_lineage
from msgsieve.sources import logs


@dataclass
class RiskModel:
    """Fitted features and classifier; turns prepared messages into ``proba``."""

    features: MessageFeaturesModel
    classifier: object

    def score(self, prepared: DataFrame) -> DataFrame:
        """Add ``proba`` and ``prediction`` to prepared messages."""
        return learners.predict(self.classifier, self.features.transform(prepared)).drop("features")

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        for name, table in self.tables().items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")

    def tables(self) -> dict[str, DataFrame]:
        """The classifier's numbers as tables, for those who score without this package."""
        found = {}
        spark = SparkSession.active()
        for part in getattr(self.classifier, "parts", [self.classifier]):
            if isinstance(part, LogisticRegressionModel):
                found["coefficients"] = regression.coefficient_table(spark, part, self.features.feature_names())
        return found

    @classmethod
    def load(cls, path: str) -> "RiskModel":
        return cls(
            MessageFeaturesModel.load(f"{path}/features"),
            learners.SoftVoteModel.load(f"{path}/classifier"),
        )

    def as_transformer(self) -> PipelineModel:
        return PipelineModel([self.features, self.classifier])


def ensure_prepared(df: DataFrame) -> DataFrame:
    """Prepare messages unless that was done before."""
    return df if "text_clean" in df.columns else prepare(df)


def _metric_map(scored: DataFrame) -> dict[str, float]:
    """The metrics table as a dict (some 16 rows).

    Several aggregations read the predictions, so they are written once.
    """
    scored = cut_lineage(scored.select("label", "prediction", "proba"))
    rows = evaluate.metrics_table(scored).collect()
    return {r["metric"] if r["class"] is None else f"{r['metric']}_{r['class']}": r["value"] for r in rows}


def _val_metrics(metrics: dict[str, float], seconds: float) -> dict[str, float]:
    named = {
        "val_accuracy": metrics["accuracy"],
        "val_precision_weighted": metrics["precision_weighted"],
        "val_recall_weighted": metrics["recall_weighted"],
        "val_f1_weighted": metrics["f1_weighted"],
        "train_time_seconds": seconds,
    }
    if "auc_roc_weighted" in metrics:
        named["val_auc_roc"] = metrics["auc_roc_weighted"]
    return named


def _stored_vectors(model: MessageFeaturesModel, prepared: DataFrame) -> DataFrame:
    """Vectors as a table in the shared folder.

    The learners pass over them hundreds of times; a table survives the loss of
    executors without featurising again.  Rebalancing gives it files of even
    size, so each pass has as many tasks as the data needs.
    """
    vectors = model.structs(prepared).select("label", "features")
    return stored_vectors(vectors.hint("rebalance"), "features", "features")


def train(
    spark: SparkSession,
    train_set: DataFrame,
    val_set: DataFrame,
    model_path: str | None = None,
    runs_path: str | None = None,
    tfidf: TfidfSettings = TfidfSettings(),
    settings: learners.LearnerSettings = learners.LearnerSettings(),
    names: tuple[str, ...] = ("lr", "rf", "gb"),
    learn_on: DataFrame | None = None,
) -> tuple[RiskModel, DataFrame]:
    """Fit features, the learners and their vote; returns the model and its run rows.

    Features and class weights are those of the whole ``train_set``; the learners see the
    rows of ``learn_on``, a part of it, or all.  The vote is always the final model.  With ``model_path`` it is saved, with
    ``runs_path`` the runs are appended to the model table.
    """
    # signals, vocabulary and vectors each pass over the prepared training messages
    prepared_train = cut_lineage(ensure_prepared(train_set).select("label", "text_clean", *fixed.SIGNALS), "prepared")
    prepared_val = ensure_prepared(val_set)
    features = MessageFeatures(settings=tfidf).fit(prepared_train)
    vectors = _stored_vectors(features, prepared_train if learn_on is None else ensure_prepared(learn_on))
    val_vectors = _stored_vectors(features, prepared_val)
    n_train, n_val = vectors.count(), val_vectors.count()  # read from file footers

    weighted = learners.with_class_weights(vectors, of=prepared_train).persist()
    val_vectors = val_vectors.persist()
    makers = {
        "lr": lambda: learners.logistic_regression(settings),
        "rf": lambda: learners.random_forest(settings),
        "gb": lambda: learners.boosted_trees(settings),
    }
    params = {
        "train_samples": str(n_train),
        "val_samples": str(n_val),
        "tfidf_max_features": str(tfidf.max_features),
        "ngram_range": str(list(tfidf.ngram_range)),
    }
    runs, parts = [], []

    def record(name: str, model, seconds: float, extra: dict[str, str]) -> None:
        metrics = _metric_map(learners.predict(model, val_vectors))
        runs.append(
            logs.model_run(
                spark,
                run=name,
                version=msgsieve.__version__,
                trained_at=dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                train_samples=n_train,
                val_samples=n_val,
                params={**params, "model_name": name, **extra},
                metrics=_val_metrics(metrics, seconds),
                model_path=model_path,
            )
        )

    try:
        total = 0.0
        for name in names:
            started = time.monotonic()
            part = makers[name]().fit(weighted)
            seconds = time.monotonic() - started
            total += seconds
            parts.append(part)
            record(name, part, seconds, {})
        weights = [dict(zip(("lr", "rf", "gb"), settings.vote_weights))[n] for n in names]
        vote = learners.SoftVoteModel(parts, weights)
        record("soft_vote", vote, total, {"voting": "soft", "weights": str(weights), "n_estimators": str(len(parts))})
    finally:
        weighted.unpersist()
        val_vectors.unpersist()

    model = RiskModel(features, vote)
    if model_path is not None:
        model.save(model_path)
    table = runs[0]
    for run in runs[1:]:
        table = table.unionByName(run)
    if runs_path is not None:
        stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        copy = f"{model_path}/metadata" if model_path else None
        logs.append_model_run(table, runs_path, stamp, copy)
    return model, table
