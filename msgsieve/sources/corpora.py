"""Labelled corpora: scans, normalisation, union, writing of splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.hashing import stable_date, stable_id
from msgsieve.functions.labels import map_label
from msgsieve.functions.text import replace_keywords
from msgsieve.sources import schemas

RAW_COLUMNS = schemas.RAW.fieldNames()
TSV_LABELS = {"ham": 0, "spam": 1}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, on any file system Spark knows."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return files is not None and len(files) > 0


def scan_tsv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Headerless two-column corpus ``label_name, text``.

    Quoted fields may span lines, which makes each file one split.  For large
    inputs of one message per line use ``multi_line=False``; quotes are then
    plain characters and files split freely.
    """
    options = {"sep": "\t", "header": "false", "encoding": "UTF-8"}
    if multi_line:
        options |= {"multiLine": "true", "quote": '"', "escape": '"'}
    else:
        options |= {"quote": ""}
    rows = spark.read.schema(schemas.TSV_CORPUS).options(**options).csv(path)
    return rows.withColumn("text", _join_quoted_part(F.col("text"))) if multi_line else rows


def _join_quoted_part(text: Column) -> Column:
    """Join a quoted part and the text that follows its closing quote.

    Spark leaves such a field as it is.  The two enclosing quotes go, doubled
    ones inside become single, and the rest is plain text.
    """
    pattern = r'(?s)^"((?:[^"]++|"")*+)"([^"].*)$'
    quoted = F.replace(F.regexp_extract(text, pattern, 1), F.lit('""'), F.lit('"'))
    return F.when(text.rlike(pattern), F.concat(quoted, F.regexp_extract(text, pattern, 2))).otherwise(text)


def scan_csv(spark: SparkSession, path: str, schema=schemas.CSV_MESSAGES, multi_line: bool = True) -> DataFrame:
    """Headered CSV, UTF-8 with or without a byte order mark.

    Quoted fields may span lines, which makes each file one split.  Large inputs
    without line breaks in fields split freely with ``multi_line=False``.
    """
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8"
    )


def missing_as_null(text: Column) -> Column:
    """Texts that stand for a missing value become null."""
    return F.when(~text.isin(fixed.NA_TEXTS), text)


def normalise_corpus(
    df: DataFrame,
    source: str,
    labels: Mapping[str, int] = TSV_LABELS,
    replacements: Mapping[str, str] = fixed.KEYWORD_REPLACEMENTS,
    key: Column | None = None,
    first_day: str = "2022-01-01",
) -> DataFrame:
    """Bring ``label_name, text`` rows to the raw message schema.

    Rows without text or with an unmapped label are dropped.  Ids and dates are
    derived from ``key`` (the text when none is given), so a rerun repeats them.
    An ``ordinal`` column stays as the order inside the corpus.
    """
    ordinal = ["ordinal"] if "ordinal" in df.columns else []
    key = F.col("text") if key is None else key
    message_id = stable_id(F.lit(source), key)
    return (
        df.dropna(subset=["text"])
        .withColumn("label", map_label(F.col("label_name"), labels))
        .where(F.col("label").isNotNull())
        .withColumns(
            {
                "message_id": message_id,
                "text": replace_keywords(F.col("text"), replacements),
                "source": F.lit(source),
                "created_at": F.date_format(
                    stable_date(first_day, 730, message_id), "yyyy-MM-dd HH:mm:ss"
                ),
            }
        )
        .select(*RAW_COLUMNS, *ordinal)
    )


def load_tsv_corpus(spark: SparkSession, path: str, source: str = "uci_sms_spam", **scan) -> DataFrame | None:
    """The TSV corpus in the raw schema, or None when the path does not exist."""
    if not path_exists(spark, path):
        return None
    rows = scan_tsv(spark, path, **scan).withColumn("text", missing_as_null(F.col("text")))
    return normalise_corpus(rows, source)


def load_csv_corpus(spark: SparkSession, path: str, **scan) -> DataFrame | None:
    """The CSV corpus in the raw schema, or None when the path does not exist."""
    return scan_csv(spark, path, **scan).select(*RAW_COLUMNS) if path_exists(spark, path) else None


def union_corpora(*corpora: DataFrame | None) -> DataFrame:
    """Union of the corpora that exist, tagged with their order.

    ``priority`` is the position in the argument list and ``ordinal`` the
    position inside a corpus.  A corpus without one is ordered by label and then by
    a hash of the whole row, which no layout of files or partitions changes.
    """
    present = [c for c in corpora if c is not None]
    if not present:
        raise ValueError("no corpus to read")
    tagged = []
    for priority, corpus in enumerate(present):
        if "ordinal" not in corpus.columns:
            mixed = F.pmod(F.xxhash64(*corpus.columns), F.lit(1 << 47))
            by_label = F.shiftleft(F.coalesce("label", F.lit(255)).cast("bigint"), 47)
            corpus = corpus.withColumn("ordinal", by_label + mixed)
        tagged.append(corpus.withColumn("priority", F.lit(priority)))
    result = tagged[0]
    for corpus in tagged[1:]:
        result = result.unionByName(corpus, allowMissingColumns=True)
    return result


def write_splits(
    df: DataFrame, path: str, file_format: str = "parquet", split: str = "split", names: Iterable[str] = ("train", "val", "test")
) -> dict[str, str]:
    """Write the splits in one pass, partitioned by split; name -> path."""
    writer = df.write.mode("overwrite").partitionBy(split)
    if file_format == "csv":
        writer = writer.options(header="true", escape='"', quote='"', encoding="UTF-8")
    writer.format(file_format).save(path)
    return {name: f"{path.rstrip('/')}/{split}={name}" for name in names}


def write_corpus(df: DataFrame, path: str, file_format: str = "csv") -> str:
    """Write a generated corpus and return its path."""
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.options(header="true", escape='"', quote='"', encoding="UTF-8")
    writer.format(file_format).save(path)
    return path


def schema_document() -> str:
    """The raw and processed schemas as JSON."""
    raw, processed = schemas.RAW.json(), schemas.PROCESSED.json()
    return f'{{"version": "1.0.0", "raw": {raw}, "processed": {processed}}}'


def write_schema(spark: SparkSession, path: str) -> str:
    """Write the schema document as one JSON line."""
    document = spark.range(1).select(F.lit(schema_document()).alias("value"))
    document.write.mode("overwrite").text(path)
    return path
