"""Ingest job: read corpora, drop duplicates, split, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgsieve.operators.augment import generate_corpus
from msgsieve.operators.dedup import keep_first
from msgsieve.operators.split import split_by_hash, split_exact
from msgsieve.sources import corpora


def merge(*sources: DataFrame | None) -> DataFrame:
    """Union of the sources that exist without duplicate texts, first kept."""
    return keep_first(corpora.union_corpora(*sources)).drop("priority", "ordinal")


def ingest(
    spark: SparkSession,
    output: str,
    csv_path: str | None = None,
    tsv_path: str | None = None,
    exact: bool = False,
    train: float = 0.70,
    val: float = 0.15,
    seed: int = 42,
    file_format: str = "parquet",
    tsv_multi_line: bool = True,
    csv_multi_line: bool = True,
) -> dict[str, str]:
    """Run the whole job; a CSV corpus that is not there is generated.

    The hash split adds no shuffle, so the job shuffles once, for duplicates.
    """
    generated = corpora.load_csv_corpus(spark, csv_path, multi_line=csv_multi_line) if csv_path else None
    if generated is None:
        generated = generate_corpus(spark, seed=seed)
        if csv_path:
            corpora.write_corpus(generated, csv_path)
            generated = corpora.load_csv_corpus(spark, csv_path, multi_line=csv_multi_line)
    labelled = (
        corpora.load_tsv_corpus(spark, tsv_path, multi_line=tsv_multi_line) if tsv_path else None
    )
    merged = merge(generated, labelled)
    if exact:
        split = split_exact(merged, train=train, val=val, seed=seed)
    else:
        split = split_by_hash(merged, train=train, val=val, seed=seed)
    return corpora.write_splits(split, output, file_format)
