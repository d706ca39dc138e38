"""The corpus pipeline: stages that each call one operator, applied to ``documents`` in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgsieve.llm.decontamination import drop_contaminated
from msgsieve.llm.near_duplicates import keep_one
from msgsieve.llm.packing import pack_stage
from msgsieve.llm.pseudonyms import pseudonym_stage
from msgsieve.llm.quality_rules import keep_good
from msgsieve.llm.tables import read
from msgsieve.session import cut_lineage

# (name, function of (spark, docs, sf_dir)); each reads all that its predecessor kept.
STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", pseudonym_stage),
    ("packing", pack_stage),
]

# Expectation-maximisation, sketches and subset-sum packing have no SQL form; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every earlier stage written to shared storage and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
