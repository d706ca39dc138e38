"""Features and learners."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from msgsieve import fixed_values as fixed
from msgsieve.operators import features, learners, regression, stats
from msgsieve.operators.augment import generate_corpus
from msgsieve.operators.prepare import prepare
from msgsieve.operators.split import split_by_hash, split_exact
from msgsieve.plans import catalog, score
from msgsieve.plans.assess import assess
from msgsieve.plans.train import RiskModel, train
from msgsieve.sources import logs

DOCS = ["b a a c", "a b", "c c c d", "a", "", "d a b zz", "only here"]


@pytest.fixture(scope="module")
def docs(spark):
    return prepare(spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")).unionByName(
        prepare(spark.createDataFrame([(9, "q")], "id int, text string")).withColumn("text_clean", F.lit(None).cast("string"))
    )


def terms_of(text):
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tfidf_against_plain_python(spark, docs):
    settings = features.TfidfSettings(max_features=4, min_df=1, max_df=0.9)
    model = features.MessageFeatures(settings=settings).fit(docs)
    texts = {i: t for i, t in enumerate(DOCS) if t} | {9: ""}
    n = len(texts)
    df, ctf = Counter(), Counter()
    for text in texts.values():
        df.update(set(terms_of(text)))
        ctf.update(terms_of(text))
    kept = sorted(sorted((t for t in df if df[t] <= 0.9 * n), key=lambda t: (-ctf[t], t))[:4])
    assert model.fitted.terms == kept
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    got = {(r["id"], r["term"]): r["weight"] for r in model.weights(docs, "id").collect()}
    want = {}
    for i, text in texts.items():
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(terms_of(text)).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, t): v / norm for t, v in raw.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_vector_layout_and_scaling(spark, docs):
    model = features.MessageFeatures(settings=features.TfidfSettings(max_features=50, min_df=1, max_df=1.0)).fit(docs)
    assert model.feature_names()[-7:] == fixed.SIGNALS
    width = len(model.feature_names())
    rows = model.transform(docs).select(vector_to_array("features").alias("f"), *fixed.SIGNALS).collect()
    matrix = np.array([r["f"] for r in rows])
    assert matrix.shape == (len(rows), width)
    raw = np.array([[float(r[n]) for n in fixed.SIGNALS] for r in rows])
    std = raw.std(axis=0)
    expected = (raw - raw.mean(axis=0)) / np.where(std == 0, 1, std)
    assert np.allclose(matrix[:, -7:], expected)
    lazily = features.scaled_signals(docs, features.signal_statistics(docs)).select(*fixed.SIGNALS).collect()
    assert np.allclose(sorted(map(tuple, lazily)), sorted(map(tuple, expected)))


def test_plain_tf_and_empty_vocabulary(spark, docs):
    plain = features.TfidfSettings(max_features=3, min_df=1, max_df=1.0, sublinear_tf=False, ngram_range=(1, 1))
    weights = features.MessageFeatures(settings=plain).fit(docs).weights(docs, "id")
    sums = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    with pytest.raises(ValueError):
        features.MessageFeatures(settings=features.TfidfSettings(min_df=99)).fit(docs)
    with pytest.raises(ValueError):
        features.MessageFeatures().fit(docs.limit(0))


def test_features_do_not_depend_on_partitions(spark, docs):
    settings = features.TfidfSettings(min_df=1, max_df=1.0)
    one = features.vocabulary(docs.coalesce(1), settings).collect()
    many = features.vocabulary(docs.repartition(16), settings).collect()
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("top,min_df", [(5, 1), (40, 2), (200, 2), (5000, 2)])
def test_counting_words_first_changes_nothing(spark, top, min_df):
    corpus = prepare(generate_corpus(spark, 60, 40, 30))
    settings = features.TfidfSettings(max_features=top, min_df=min_df, max_df=0.3)
    n = corpus.count()
    every = features.term_statistics(corpus, settings).where((F.col("df") >= min_df) & (F.col("df") <= 0.3 * n))
    want = sorted(((r["term"], r["df"], r["ctf"]) for r in every.collect()), key=lambda r: (-r[2], r[0]))[:top]
    got = features.vocabulary(corpus, settings).select("term", "df", "ctf").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stored_vectors_equal_lazy_ones(spark, docs):
    model = features.MessageFeatures(settings=features.TfidfSettings(min_df=1, max_df=1.0)).fit(docs)
    lazy = sorted(str(r["features"]) for r in model.transform(docs).collect())
    stored = features.stored_vectors(model.structs(docs).select("features"), "features")
    assert sorted(str(r["features"]) for r in stored.collect()) == lazy


@pytest.mark.parametrize("names", [("lr",), ("gb",), ("rf", "gb"), ("lr", "gb")])
def test_any_choice_of_learners_is_saved_and_loaded(spark, tmp_path, names):
    corpus = split_exact(generate_corpus(spark, 12, 10, 8), train=0.8, val=0.2)
    small = learners.LearnerSettings(lr_iterations=5, rf_trees=2, rf_depth=2, gb_rounds=1, gb_depth=1)
    fit_on, held = corpus.where("split = 'train'"), corpus.where("split = 'val'")
    model, _ = train(spark, fit_on, held, str(tmp_path / "m"), settings=small, names=names)
    loaded = RiskModel.load(str(tmp_path / "m"))
    key = lambda df: sorted((r["message_id"], tuple(r["proba"])) for r in df.collect())
    assert key(loaded.score(prepare(held))) == key(model.score(prepare(held)))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(None,)], "label int")
    got = {r["label"]: r["weight"] for r in features.class_weights(df).collect()}
    assert got == {0: pytest.approx(0.75), 1: pytest.approx(1.5)}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    """The whole training job on 240 generated messages with few, small trees."""
    root = str(tmp_path_factory.mktemp("model"))
    corpus = split_exact(generate_corpus(spark, 100, 80, 60), train=0.8, val=0.2)
    small = learners.LearnerSettings(lr_iterations=60, rf_trees=10, rf_depth=6, gb_rounds=3, gb_depth=3)
    fit_on, held = corpus.where("split = 'train'"), corpus.where("split = 'val'")
    model, runs = train(spark, fit_on, held, f"{root}/m", f"{root}/runs", settings=small)
    return model, runs, prepare(held).persist(), root


def test_training_runs(spark, trained):
    _, runs, held, root = trained
    rows = {r["run"]: r for r in runs.collect()}
    assert set(rows) == {"lr", "rf", "gb", "soft_vote"}
    assert rows["soft_vote"]["metrics"]["val_accuracy"] >= 0.70
    assert rows["lr"]["metrics"]["val_accuracy"] >= 0.70
    assert rows["lr"]["train_samples"] + rows["lr"]["val_samples"] == 240
    stored = logs.scan_model_runs(spark, f"{root}/runs")
    assert stored.count() == 4
    comparison = [r["f1_weighted"] for r in stats.model_comparison(stored).collect()]
    assert comparison == sorted(comparison, reverse=True)
    info = stats.model_info(stored.where("run = 'soft_vote'")).first()
    assert info["model_loaded"] and info["train_samples"] == rows["lr"]["train_samples"]


def test_vote_probabilities(spark, trained):
    model, _, held, _ = trained
    vectors = model.features.transform(held)
    parts = [learners.class_probabilities(p, vectors).select("message_id", "proba") for p in model.classifier.parts]
    separate = [{r["message_id"]: r["proba"] for r in p.collect()} for p in parts]
    for r in model.score(held).collect():
        assert sum(r["proba"]) == pytest.approx(1)
        assert r["prediction"] == int(np.argmax(r["proba"]))
        mean = np.average([s[r["message_id"]] for s in separate], axis=0, weights=[2, 1, 2])
        assert np.allclose(mean, r["proba"])


def test_saved_model_scores_the_same(spark, trained):
    model, _, held, root = trained
    loaded = RiskModel.load(f"{root}/m")
    assert loaded.features.feature_names() == model.features.feature_names()
    assert loaded.classifier.weights == [2.0, 1.0, 2.0]
    key = lambda df: sorted((r["message_id"], tuple(r["proba"])) for r in df.collect())
    assert key(loaded.score(held)) == key(model.score(held))
    staged = model.as_transformer()
    staged.write().overwrite().save(f"{root}/staged")
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(f"{root}/staged").transform(held)
    assert key(again) == key(model.score(held))


def test_assessment(spark, trained, tmp_path):
    model, _, held, _ = trained
    result = assess(model, held, str(tmp_path / "report"))
    names = {r["metric"] for r in result["metrics"].collect()}
    assert {"accuracy", "f1_macro", "auc_roc_weighted", "recall"} <= names
    assert sum(r["n"] for r in result["confusion"].collect()) == held.count()
    assert spark.read.json(str(tmp_path / "report" / "report")).count() == 6


def test_assessment_equals_sql_over_the_written_predictions(spark, trained, tmp_path):
    import duckdb

    model, _, held, _ = trained
    path = str(tmp_path / "scored")
    model.score(held).select("label", "prediction", "proba").write.parquet(path)
    sql = f"""
    WITH s AS (SELECT * FROM read_parquet('{path}/*.parquet')),
    c AS (SELECT k, count(*) FILTER (WHERE label = k AND prediction = k) AS hit, count(*) FILTER (WHERE label = k) AS support,
      count(*) FILTER (WHERE prediction = k) AS predicted FROM s, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
    p AS (SELECT k, proba[k + 1] AS score, label = k AS pos FROM s, (SELECT unnest([0, 1, 2]) AS k)),
    a AS (SELECT x.k, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auc
      FROM p x JOIN p y ON x.k = y.k AND x.pos AND NOT y.pos GROUP BY x.k)
    SELECT (SELECT avg((label = prediction)::INT) FROM s), (SELECT sum(2.0 * hit * support / (support + predicted)) / sum(support) FROM c),
      (SELECT sum(auc * support) / sum(support) FROM a JOIN c USING (k)), (SELECT avg(auc) FROM a)"""
    want = duckdb.sql(sql).fetchall()[0]
    found = {r["metric"]: r["value"] for r in assess(model, held)["metrics"].where("class IS NULL").collect()}
    got = [found[m] for m in ("accuracy", "f1_weighted", "auc_roc_weighted", "auc_roc_macro")]
    assert got == pytest.approx(list(want))


def test_scoring_job(spark, trained):
    model, *_ = trained
    requests = spark.createDataFrame(
        [("1", " ยินดีด้วยคุณได้รับรางวัล 100,000 บาท "), ("2", ""), ("3", "x" * 2001), ("4", "สวัสดีครับ วันนี้อากาศดี")],
        "message_id string, text string",
    )
    checked = score.check_requests(requests)
    assert {r["message_id"] for r in score.rejected(checked).collect()} == {"2", "3"}
    got = {r["message_id"]: r for r in score.score_messages(score.accepted(checked), model).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"]["text"] == "ยินดีด้วยคุณได้รับรางวัล 100,000 บาท"
    assert 0 <= got["1"]["confidence"] <= 1 and got["1"]["confidence_source"] == "ml"
    blank = score.score_messages(requests.where("message_id = '2'"), model).first()
    assert (blank["label"], blank["confidence"]) == ("ham", 1.0)
    risky = score.replies(score.score_messages(score.accepted(checked), model), "message_id", "label").collect()
    assert all(r["label"] != "ham" and "1599" in r["reply"] for r in risky)


def test_scores_of_all_labelled_rows_however_few_are_fitted(spark, data, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_TRAINING_ROWS", 20)
    want = sorted(r["doc_id"] for r in catalog.labelled(spark, data, "doc_id", "text").collect())
    assert len(want) > 20
    assert sorted(r["doc_id"] for r in catalog.logistic_regression_scores(spark, data).collect()) == want


def test_features_come_from_the_whole_train_split(spark, data, monkeypatch):
    seen, real = [], catalog.train.train
    monkeypatch.setattr(catalog, "MOST_TRAINING_ROWS", 20)
    monkeypatch.setattr(catalog.train, "train", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    catalog.logistic_regression_scores(spark, data)
    (model, runs), = seen
    rows = prepare(split_by_hash(catalog.labelled(spark, data, "doc_id", "text"))).where("split = 'train'")
    whole = features.MessageFeatures().fit(rows).fitted
    assert rows.count() > 20 and {r["train_samples"] for r in runs.collect()} == {20}
    assert model.features.fitted.terms == whole.terms and model.features.fitted.idf == pytest.approx(whole.idf)
    assert model.features.fitted.means == pytest.approx(whole.means)


def test_learners_see_the_whole_train_split(spark, tmp_path, monkeypatch):
    """More rows than any trial's cut: none is left out of the fit, copies and null texts as the split has them."""
    n = 32_000
    docs = spark.range(n).selectExpr(
        "id as doc_id", "if(id % 1000 = 0, null, concat_ws(' ', 'w' || id % 7, 'v' || id % 11, 'x' || id % 3, 'n' || id)) as text",
        "'en' as lang", "'web' as source")
    docs.unionByName(docs.where("doc_id < 50")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality", "cast(id % 7 = 0 as int) as toxic").write.parquet(
        f"{tmp_path}/labels.parquet")
    rows = prepare(split_by_hash(catalog.labelled(spark, str(tmp_path), "doc_id", "text")))
    want = sorted(r[0] for r in rows.where("split = 'train'").select("doc_id").collect())
    assert len(want) > 20_000
    seen = []
    monkeypatch.setattr(catalog.train, "train", lambda *a, learn_on, **k: seen.append(learn_on) or (None, None))
    monkeypatch.setattr(catalog.stats, "model_comparison", lambda runs: runs)
    catalog._regression(spark, str(tmp_path))
    catalog.vote_training_runs(spark, str(tmp_path))
    for fit_on in seen:
        assert sorted(r[0] for r in fit_on.select("doc_id").collect()) == want
    assert len(seen) == 2


def test_rows_for_learners_are_chosen_by_id_alone(spark):
    """Texts do not go through the sort; copies of the last id fill what room there is."""
    ids = spark.range(200).selectExpr("id % 90 as doc_id", "id", "repeat('x', 9) as text").repartition(7)
    for most in (1, 57, 200, 500):
        found = catalog._first_by_hash(ids, most)
        ordered = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in ordered.select("doc_id").collect())
        assert found.select("id").distinct().count() == min(most, 200)
        assert "TakeOrderedAndProject" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_passes_on_an_uneven_objective():
    scale = np.geomspace(1, 1e4, 120)
    passes = []

    def value(point):
        passes.append(point)
        return float((scale * point * point).sum()) / 2, scale * point

    point, lengths = regression.minimise(value, np.ones(120), 1e-8, 1000)
    assert lengths[-1] <= 1e-8 and np.abs(point).max() < 1e-8
    assert len(passes) < 800


def test_few_passes_when_some_columns_are_heavy(spark, monkeypatch):
    """Two signals that go together and outweigh all terms do not lengthen the way; the end is the same."""
    passes, real = [], regression.Sums.__call__
    monkeypatch.setattr(regression.Sums, "__call__", lambda self, flat: passes.append(1) or real(self, flat))
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        at = np.sort(rng.choice(40, 6, replace=False))
        signal = rng.normal(0, 30)
        values = [*rng.random(6), signal, signal + rng.normal()]
        rows.append((int(rng.integers(3)) if k % 3 else int(at[0] % 3), 1.0 + k % 2, Vectors.sparse(42, [*at.tolist(), 40, 41], values)))
    table = spark.createDataFrame(rows, ["label", "weight", "features"])
    found = regression.SoftmaxRegression().fit(table).coefficientMatrix.toArray()
    some = len(passes)
    monkeypatch.setattr(regression, "flattened", lambda sums, c: None)
    without = regression.SoftmaxRegression().fit(table).coefficientMatrix.toArray()
    assert np.allclose(found, without, atol=1e-7)
    assert 2 * some < len(passes) - some, (some, len(passes))


def test_curvature_is_the_change_of_the_gradient():
    rng = np.random.default_rng(6)
    at = [np.sort(rng.choice(5, 3, replace=False)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(rng.integers(3, size=20)), pa.array(rng.random(20)), pa.array(at, pa.list_(pa.int32())),
         pa.array(list(rng.normal(size=(20, 3))), pa.list_(pa.float64()))], ["label", "weight", "at", "x"])
    params, heavy = rng.normal(size=(6, 3)), np.array([1, 3, 5])
    alone, together = regression.batch_curvature(batch, params, heavy)
    for j in range(6):
        for k in range(3):
            moved = params.copy()
            moved[j, k] += 1e-6
            change = (regression.batch_sums(batch, moved)[1] - regression.batch_sums(batch, params)[1]) / 1e-6
            assert alone[k, :, j] == pytest.approx(change[:, j], abs=1e-4)
            if j in heavy:
                assert together[k, heavy.tolist().index(j)] == pytest.approx(change[:, heavy], abs=1e-4)


def test_passes_do_not_carry_the_plan_of_their_rows(spark, monkeypatch):
    seen, made = [], regression.Sums.__init__
    monkeypatch.setattr(regression.Sums, "__init__", lambda self, rows, *a: seen.append(rows) or made(self, rows, *a))
    rows = [(k % 3, Vectors.sparse(4, [k % 4], [1.0])) for k in range(60)]
    regression.SoftmaxRegression().fit(learners.with_class_weights(spark.createDataFrame(rows, ["label", "features"]).persist()))
    plan = seen[0].toDebugString().decode()
    assert "Join" not in plan and plan.count("ParallelCollectionRDD") == 0


def test_passes_use_all_cores(spark, monkeypatch):
    parts, made = [], regression.Sums.__init__

    def noted(self, rows, width, classes):
        made(self, rows, width, classes)
        parts.append(self.parts)

    monkeypatch.setattr(regression.Sums, "__init__", noted)
    rows = [(k % 3, 1.0, Vectors.sparse(4, [k % 4], [1.0])) for k in range(60)]
    regression.SoftmaxRegression().fit(spark.createDataFrame(rows, ["label", "weight", "features"]).coalesce(1))
    assert parts == [spark.sparkContext.defaultParallelism]


def test_passes_are_one_job_of_a_task_per_core(spark, monkeypatch):
    """Many small files make no more tasks than cores; large tables are cut into parts of bounded size."""
    parts, made = [], regression.Sums.__init__

    def noted(self, rows, width, classes):
        made(self, rows, width, classes)
        parts.append(self.parts)

    monkeypatch.setattr(regression.Sums, "__init__", noted)
    rows = [(k % 3, 1.0, Vectors.sparse(4, [k % 4], [1.0]) if k % 2 else Vectors.dense(1, 0, k % 5, 2)) for k in range(60)]
    table = spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(50)
    one = regression.SoftmaxRegression().fit(table)
    monkeypatch.setattr(regression, "PART_BYTES", 150)
    monkeypatch.setattr(regression, "PARTS_AT_ONCE", 4)
    other = regression.SoftmaxRegression().fit(table)
    cells = 30 + 4 * 30
    assert parts == [spark.sparkContext.defaultParallelism, 12 * cells // 150]
    assert np.allclose(one.coefficientMatrix.toArray(), other.coefficientMatrix.toArray(), atol=1e-7)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 2), (2, 3)])
def test_terms_are_counted_by_chunks(spark, monkeypatch, ngrams):
    """Chunk limits and long messages change no count; no n-gram crosses from one message into the next."""
    texts = ["b a b a", "", None, "a b", "c a b a b a b c", "x", "é a b ß"]
    df, ctf = Counter(), Counter()
    for text in texts:
        t = (text or "").split()
        terms = [" ".join(t[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(t) - n + 1)]
        ctf.update(terms)
        df.update(set(terms))
    table = pa.table({"tokens": [(t or "").split() for t in texts]}).combine_chunks().to_batches()[0]
    for most in (1, 5, 100):
        monkeypatch.setattr(features, "TOKENS_AT_ONCE", most)
        found = [r for words, row in features._token_chunks(table) for b in features._counted(words, row, ngrams) for r in b.to_pylist()]
        for name, right in (("df", df), ("ctf", ctf)):
            total = Counter()
            for r in found:
                total[r["term"]] += r[name]
            assert total == right
    docs = spark.createDataFrame([(t,) for t in texts], "text_clean string")
    rows = features.term_statistics(docs, features.TfidfSettings(ngram_range=ngrams)).collect()
    assert {r["term"]: (r["df"], r["ctf"]) for r in rows} == {t: (df[t], ctf[t]) for t in ctf}


@pytest.fixture(scope="module")
def scattered(spark):
    """120 rows of 6 features in 50 parts."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(120):
        values = rng.normal(size=6)
        label = int(values[0] > 0.2) + int(values[1] > 0.4)
        rows.append((label, 1.0 + k % 2, Vectors.dense(values) if k % 2 else Vectors.sparse(6, range(6), values)))
    return spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(50).persist()


@pytest.mark.parametrize("part_bytes,parts", [(128 << 20, 1), (4 * 6 * 40, 3)])
def test_trees_are_grown_on_as_few_parts_as_hold_the_rows(spark, scattered, monkeypatch, part_bytes, parts):
    """Each part makes and sends the histograms of all nodes."""
    seen = []
    for kind in (learners.GBTClassifier, learners.RandomForestClassifier):
        fit = kind._fit
        monkeypatch.setattr(
            kind, "_fit", lambda self, rows, fit=fit: seen.append((rows.rdd.getNumPartitions(), rows.count())) or fit(self, rows)
        )
    for name in ("FOREST_PART_BYTES", "BOOSTING_PART_BYTES", "GROUP_TREES"):
        monkeypatch.setattr(learners, name, 2 if name == "GROUP_TREES" else part_bytes)
    small = learners.LearnerSettings(rf_trees=3, rf_depth=3, gb_rounds=1, gb_depth=2)
    learners.boosted_trees(small).fit(scattered)
    learners.random_forest(small).fit(scattered)
    assert seen == [(parts, 120)] * 5


def test_a_forest_of_groups_is_one_forest(spark, scattered, monkeypatch, tmp_path):
    settings = learners.LearnerSettings(rf_trees=5, rf_depth=4)
    text = lambda model: model.toDebugString.split("\n", 1)[1]
    alone = learners.random_forest(settings).fit(scattered)
    monkeypatch.setattr(learners, "GROUP_TREES", 2)
    model = learners.random_forest(settings).fit(scattered)
    assert alone.getNumTrees == model.getNumTrees == len(model.trees) == 5
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 3, "groups draw rows and features of their own"
    assert text(model) == text(learners.random_forest(settings).fit(scattered))
    assert (model.numClasses, model.numFeatures, model.getProbabilityCol()) == (3, 6, "_probability")
    key = lambda df: sorted((tuple(r["f"]), tuple(r["proba"])) for r in df.select(vector_to_array("features").alias("f"), "proba").collect())
    scores = key(learners.predict(model, scattered))
    single = [dict(key(t.setProbabilityCol("proba").transform(scattered).withColumn("proba", vector_to_array("proba")))) for t in model.trees]
    assert all(p == pytest.approx(np.mean([s[f] for s in single], axis=0)) for f, p in scores)
    model.write().save(str(tmp_path / "forest"))
    loaded = learners.RandomForestClassificationModel.load(str(tmp_path / "forest"))
    assert key(learners.predict(loaded, scattered)) == scores
