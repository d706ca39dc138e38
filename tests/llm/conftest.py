import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table like ``documents`` from texts or (doc_id, text) pairs."""

    def make(*rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCUMENTS)

    return make


@pytest.fixture
def folder(tmp_path):
    """Writes tables into a folder that queries can read."""

    def write(**tables):
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
