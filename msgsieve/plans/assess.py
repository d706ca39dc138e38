"""Evaluation job on a test set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from msgsieve.operators import evaluate
from msgsieve.plans.train import RiskModel, ensure_prepared
from msgsieve.session import cut_lineage


def assess(model: RiskModel, test_set: DataFrame, output: str | None = None) -> dict[str, DataFrame]:
    """Metrics, confusion matrix and report of a model on a test set.

    Messages are scored once and the three columns the metrics need are kept in
    a table.  With ``output`` the metrics go there as Parquet and the confusion
    matrix and report as JSON.
    """
    scored = model.score(ensure_prepared(test_set))
    scored = cut_lineage(scored.select("label", "prediction", "proba"), "scored")
    result = {
        "metrics": evaluate.metrics_table(scored),
        "confusion": evaluate.confusion_matrix(scored),
        "report": evaluate.report_rows(scored),
    }
    if output is not None:
        result["metrics"].write.mode("overwrite").parquet(f"{output}/metrics")
        result["confusion"].write.mode("overwrite").json(f"{output}/confusion")
        result["report"].write.mode("overwrite").json(f"{output}/report")
    return result
