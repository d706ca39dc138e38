"""The pipeline as a whole against plain versions of its stages."""

import corpus_pipeline
from llm_brute import classes, tokens_of
from msgsieve.llm import quality_rules
from msgsieve.llm.tables import DOCUMENT_COLUMNS, read
from test_operators_llm import PRIVATE, best_similarity


def test_stages_and_run(spark, data):
    docs = read(spark, data, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in read(spark, data, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == DOCUMENT_COLUMNS
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality rules":
            judged, _ = quality_rules.judge(read(spark, data, "documents"))
            assert set(after) == {r["doc_id"] for r in judged.where("kept").collect()}
        elif name == "near-duplicates":
            assert set(after) == {i for i, c in classes(before, 5).items() if i == c}
        elif name == "benchmark decontamination":
            plain = [" ".join(x.lower().replace(".", " ").replace(",", " ").split()) for x in items]
            clean = {i: " ".join(t.lower().replace(".", " ").replace(",", " ").split()) for i, t in before.items()}
            exact = {i for i, t in clean.items() if any(f" {p} " in f" {t} " for p in plain)}
            assert exact <= set(before) - set(after)
            assert all(max(best_similarity(clean[i], p) for p in plain) >= 0.8 for i in set(before) - set(after))
        else:
            assert set(after) == set(before) and all(len(after[i]) == len(before[i]) for i in after if "." not in before[i])
        before = after
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(before)
    for doc_id, text in before.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == doc_id) == len(tokens_of(text)) + 1


def test_pipeline_of_odd_rows(spark, documents, folder):
    good = " ".join(f"lower words number {'abcdefghijklmnop'[i % 16]}{'qrstuvwx'[i % 8]} here" for i in range(12))
    docs = documents((1, good + f" {PRIVATE[0][0]}"), (2, good + f" {PRIVATE[0][0]}"), (None, None), (4, ""), (5, "### " * 80))
    benchmark = spark.createDataFrame([(0, None)], "item_id bigint, text string")
    path = folder(documents=docs.withColumn("_document", docs["text"]).withColumn("kept", docs["doc_id"]), benchmark=benchmark)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} <= {1}
