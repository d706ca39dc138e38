"""TF-IDF terms, scaled signals and the combined feature vector.

Terms are counted by chunks of messages inside each task, so the only shuffle of the
feature stage is the one that adds these counts up.
The fitted vocabulary is bounded by ``max_features`` and goes to every task;
turning messages into vectors is then a projection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from msgsieve import fixed_values as fixed
from msgsieve.functions import text as tx
from msgsieve.functions.evaluation import bind, computed_once
from msgsieve.operators.prepare import signal_columns, text_column
from msgsieve.session import cut_lineage, new_table_path


@dataclass(frozen=True)
class TfidfSettings:
    """Vectoriser settings; the defaults are those of the training job."""

    max_features: int = 5000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int | float = 2
    max_df: int | float = 0.95
    sublinear_tf: bool = True
    token_mode: str = "compat"

    def terms(self, text: Column) -> Column:
        return tx.ngrams(tx.word_tokens(text, self.token_mode), self.ngram_range)

    def limit(self, bound: int | float, n_docs: Column) -> Column:
        """A document-frequency bound; fractions are shares of the corpus."""
        return F.lit(bound) if isinstance(bound, int) else F.lit(bound) * n_docs


def inverse_document_frequency(df: Column, n_docs: Column) -> Column:
    """Smoothed: ``ln((1 + n) / (1 + df)) + 1``."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


TOKENS_AT_ONCE = 1_000_000  # tokens whose terms a task counts together; one message at least


def _token_chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Tokens of some messages, one after the other, and the place of the message of each."""
    listed = batch.column(0)
    offsets, words = listed.offsets.to_numpy().astype(np.int64), listed.flatten()
    offsets = offsets - offsets[0]
    first = 0
    while first < len(listed):
        last = max(int(np.searchsorted(offsets, offsets[first] + TOKENS_AT_ONCE, "right")) - 1, first + 1)
        sizes = np.diff(offsets[first : last + 1])
        yield words.slice(offsets[first], offsets[last] - offsets[first]), np.repeat(np.arange(last - first), sizes)
        first = last


def _counted(words: pa.Array, row: np.ndarray, ngram_range: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """``term, df, ctf`` of the n-grams of a chunk; an n-gram stays within its message."""
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    key, rows = codes, int(row[-1]) + 1 if len(row) else 0
    for n in range(1, ngram_range[1] + 1):
        if n > 1:  # the n-grams so far, numbered, and the word after them
            _, short = np.unique(key, return_inverse=True)
            key = short[: max(len(codes) - n + 1, 0)] * len(names) + codes[n - 1 :]
        inside = np.flatnonzero(row[: len(key)] == row[n - 1 :])
        if n < ngram_range[0] or not len(inside):
            continue
        _, at, term, ctf = np.unique(key[inside], return_index=True, return_inverse=True, return_counts=True)
        df = np.bincount(np.unique(term * rows + row[inside]) // rows, minlength=len(at))
        at = inside[at]
        parts = [names.take(pa.array(codes[at + k])) for k in range(n)]
        joined = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([joined, pa.array(df, pa.int64()), pa.array(ctf, pa.int64())], ["term", "df", "ctf"])


def term_statistics(
    docs: DataFrame,
    settings: TfidfSettings = TfidfSettings(),
    text: str = "text_clean",
    words: DataFrame | None = None,
) -> DataFrame:
    """Document frequency ``df`` and corpus frequency ``ctf`` of every term.

    With ``words`` (a table of one column ``word``) only terms that begin and end
    with one of these words are counted.
    """
    ngram_range = settings.ngram_range

    def of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, row in _token_chunks(batch):
                yield from _counted(words, row, ngram_range)

    tokens = docs.select(tx.word_tokens(text_column(docs, text), settings.token_mode).alias("tokens"))
    entries = tokens.mapInArrow(of_tokens, "term string, df long, ctf long")
    if words is not None:
        ends = {"_first": F.substring_index("term", " ", 1), "_last": F.substring_index("term", " ", -1)}
        entries = entries.withColumns(ends)
        for end in ends:
            entries = entries.join(words.withColumnRenamed("word", end), end, "left_semi")
    return entries.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def vocabulary(
    docs: DataFrame,
    settings: TfidfSettings = TfidfSettings(),
    text: str = "text_clean",
    n_docs: Column | None = None,
) -> DataFrame:
    """Kept terms with ``df``, ``ctf``, ``idf`` and column index.

    Document-frequency bounds first, then the ``max_features`` terms of highest
    corpus frequency, ties by term.  Columns are numbered in term order; that
    window runs over the kept terms only, at most ``max_features`` rows.

    Counting every word sequence of a corpus shuffles more than the corpus itself,
    so words are counted first.  A sequence occurs at most as often as its rarest
    word: if ``max_features`` kept words occur at least ``c`` times, no term below
    ``c`` is kept, and sequences with a word below ``c`` leave no task.  The words
    from ``c`` on are a table; where it is small the join needs no shuffle.
    """
    if n_docs is None:
        n_docs = docs.agg(F.count(F.lit(1))).scalar()

    def within_bounds(terms: DataFrame) -> DataFrame:
        low, high = settings.limit(settings.min_df, n_docs), settings.limit(settings.max_df, n_docs)
        return terms.where((F.col("df") >= low) & (F.col("df") <= high))

    low, high = settings.ngram_range
    if low > 1:
        kept = within_bounds(term_statistics(docs, settings, text))
    else:
        words = cut_lineage(term_statistics(docs, replace(settings, ngram_range=(1, 1)), text), "words")
        kept = within_bounds(words)
        if high > 1:
            best = kept.orderBy(F.desc("ctf")).limit(settings.max_features).agg(
                F.when(F.count("*") == settings.max_features, F.min("ctf")).otherwise(0))
            frequent = cut_lineage(words.where(F.col("ctf") >= best.scalar()).select(F.col("term").alias("word")), "frequent")
            longer = term_statistics(docs, replace(settings, ngram_range=(2, high)), text, frequent)
            kept = kept.unionByName(within_bounds(longer))
    top = kept.orderBy(F.desc("ctf"), "term").limit(settings.max_features)
    return top.select(
        "term",
        "df",
        "ctf",
        inverse_document_frequency(F.col("df"), n_docs).alias("idf"),
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
    )


def _signal_values(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the signals, each computed once for all aggregates over it."""
    return computed_once(docs, {f"_{n}": c for n, c in zip(names, signal_columns(docs, names))}).select(
        *[F.col(f"_{n}").alias(n) for n in names]
    )


def signal_statistics(docs: DataFrame, names: Sequence[str] = tuple(fixed.SIGNALS)) -> DataFrame:
    """Mean and population deviation of each signal, one row per signal."""
    values = _signal_values(docs, names)
    one_row = values.agg(
        *[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_pop(n).alias(f"std_{n}") for n in names]
    )
    rows = [
        F.struct(F.lit(n).alias("signal"), F.col(f"mean_{n}").alias("mean"), F.col(f"std_{n}").alias("std"))
        for n in names
    ]
    return one_row.select(F.inline(F.array(*rows)))


def scale(value: Column, mean: Column, std: Column) -> Column:
    """``(value - mean) / std``; a constant column is only centred."""
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def scaled_signals(
    docs: DataFrame, statistics: DataFrame, names: Sequence[str] = tuple(fixed.SIGNALS)
) -> DataFrame:
    """Replace the signals by their scaled values; ``statistics`` has one row per signal."""
    lookup = statistics.agg(
        F.map_from_entries(F.collect_list(F.struct("signal", F.struct("mean", "std")))).alias("s")
    ).scalar()
    raw = computed_once(
        docs, {**{n: c for n, c in zip(names, signal_columns(docs, names))}, "_s": lookup}
    )
    return raw.withColumns(
        {n: scale(F.col(n), F.col("_s")[n]["mean"], F.col("_s")[n]["std"]) for n in names}
    ).drop("_s")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (classes * n_class)`` per label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    both = totals.select(F.struct("total", "classes")).scalar()
    return computed_once(counts, {"_t": both}).select(
        label, "n", (F.col("_t.total") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )


def _constant_array(values: Sequence[float]) -> Column:
    """A double array literal, folded once by the optimizer."""
    joined = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(joined), ",").cast("array<double>")


VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def as_vector(struct: Column) -> Column:
    """``struct<type, size, indices, values>`` as a vector column of a lazy plan.

    Spark has no expression from a struct to a vector, so this goes through text;
    training uses ``stored_vectors``, which does not.
    """
    return F.from_json(F.to_json(F.struct(struct.alias("v"))), VECTOR)["v"]


def stored_vectors(structs: DataFrame, column: str, name: str = "vectors") -> DataFrame:
    """Write rows with a vector as a struct in ``column`` and read it back as a vector.

    Both have the same Parquet form, so nothing is converted.
    """
    path = new_table_path(structs.sparkSession, name)
    structs.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in structs.schema]
    return structs.sparkSession.read.schema(T.StructType(fields)).parquet(path)


class _FeatureParams(Params):
    """Columns shared by the estimator and the model."""

    inputCol = Param(Params._dummy(), "inputCol", "prepared text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "vectoriser settings as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            inputCol="text_clean", outputCol="features", settings=json.dumps(asdict(TfidfSettings()))
        )

    def get_settings(self) -> TfidfSettings:
        values = json.loads(self.getOrDefault(self.settings))
        return TfidfSettings(**{**values, "ngram_range": tuple(values["ngram_range"])})


class MessageFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits vocabulary, idf and signal scaling on prepared messages."""

    @keyword_only
    def __init__(self, *, inputCol="text_clean", outputCol="features", settings=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if isinstance(given.get("settings"), TfidfSettings):
            given["settings"] = json.dumps(asdict(given["settings"]))
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> "MessageFeaturesModel":
        names = fixed.SIGNALS
        values = _signal_values(dataset, names)
        first = values.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(n).alias(f"mean_{n}") for n in names],
            *[F.stddev_pop(n).alias(f"std_{n}") for n in names],
        ).first()
        if not first["n"]:
            raise ValueError("cannot fit features on an empty table")
        terms = (
            vocabulary(
                dataset,
                self.get_settings(),
                self.getOrDefault(self.inputCol),
                n_docs=F.lit(first["n"]),
            )
            .orderBy("idx")
            .select("term", "idf")
            .collect()  # at most max_features rows
        )
        if not terms:
            raise ValueError("no term passes the document-frequency bounds")
        model = MessageFeaturesModel(
            Fitted(
                terms=[r["term"] for r in terms],
                idf=[r["idf"] for r in terms],
                means=[first[f"mean_{n}"] for n in names],
                stds=[first[f"std_{n}"] for n in names],
            )
        )
        return self._copyValues(model)


@dataclass
class Fitted:
    """What fitting learns; bounded by ``max_features``."""

    terms: list[str] = field(default_factory=list)
    idf: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)


class MessageFeaturesModel(Model, _FeatureParams, MLReadable, MLWritable):
    """Adds the vector TF-IDF ⊕ scaled signals; a projection without shuffle."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self.fitted = fitted or Fitted()

    def feature_names(self) -> list[str]:
        """Terms in column order, then the signals."""
        return [*self.fitted.terms, *fixed.SIGNALS]

    def vocabulary_table(self, spark) -> DataFrame:
        rows = list(zip(range(len(self.fitted.terms)), self.fitted.terms, self.fitted.idf))
        return spark.createDataFrame(rows, "idx int, term string, idf double")

    def _weights(self, dataset: DataFrame) -> DataFrame:
        """Add ``_w``: indices and L2-normalised weights of the known terms."""
        settings = self.get_settings()
        counter = CountVectorizerModel.from_vocabulary(self.fitted.terms, inputCol="_terms", outputCol="_tf")
        text = text_column(dataset, self.getOrDefault(self.inputCol))
        counted = counter.transform(dataset.withColumn("_terms", settings.terms(text)))
        idf = _constant_array(self.fitted.idf)
        weigh = (lambda tf: F.lit(1.0) + F.log(tf)) if settings.sublinear_tf else (lambda tf: tf)

        def normalise(entry: Column) -> Column:
            raw = F.zip_with(
                entry["indices"], entry["values"], lambda i, tf: weigh(tf) * F.get(idf, i)
            )
            return bind(
                raw,
                lambda w: bind(
                    F.sqrt(F.aggregate(w, F.lit(0.0), lambda total, x: total + x * x)),
                    lambda norm: F.struct(
                        entry["indices"].alias("indices"),
                        F.transform(w, lambda x: x / norm).alias("weights"),
                    ),
                ),
            )

        return counted.withColumn("_w", bind(F.unwrap_udt("_tf"), normalise)).drop("_terms", "_tf")

    def weights(self, dataset: DataFrame, *keys: str) -> DataFrame:
        """Long form: one row per (message, known term) with its weight."""
        names = F.split(F.lit("\x1f".join(self.fitted.terms)), "\x1f")
        entries = F.arrays_zip(F.col("_w.indices").alias("idx"), F.col("_w.weights").alias("weight"))
        exploded = self._weights(dataset).select(*keys, F.explode(entries).alias("e"))
        return exploded.select(
            *keys, F.col("e.idx").alias("idx"), F.get(names, F.col("e.idx")).alias("term"), F.col("e.weight").alias("weight")
        )

    def structs(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with the vector's parts as a struct in the output column."""
        width, extra = len(self.fitted.terms), len(fixed.SIGNALS)
        scaled = F.array(
            *[
                scale(value, F.lit(float(mean)), F.lit(float(std)))
                for value, mean, std in zip(signal_columns(dataset), self.fitted.means, self.fitted.stds)
            ]
        )
        positions = F.array(*[F.lit(width + k) for k in range(extra)])
        struct = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(width + extra).alias("size"),
            F.concat("_w.indices", positions).alias("indices"),
            F.concat("_w.weights", scaled).alias("values"),
        )
        return self._weights(dataset).withColumn(self.getOrDefault(self.outputCol), struct).drop("_w")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        output = self.getOrDefault(self.outputCol)
        return self.structs(dataset).withColumn(output, as_vector(F.col(output)))

    def write(self) -> MLWriter:
        return _FeaturesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeaturesReader()


class _FeaturesWriter(MLWriter):
    def __init__(self, instance: MessageFeaturesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, model = self.sparkSession, self.instance
        scaling = {"means": model.fitted.means, "stds": model.fitted.stds}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata=scaling)
        model.vocabulary_table(spark).coalesce(1).write.parquet(f"{path}/vocabulary")


class _FeaturesReader(MLReader):
    def load(self, path: str) -> MessageFeaturesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/vocabulary").orderBy("idx").collect()
        model = MessageFeaturesModel(
            Fitted(
                terms=[r["term"] for r in rows],
                idf=[r["idf"] for r in rows],
                means=metadata["means"],
                stds=metadata["stds"],
            )
        )
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
