"""Registered queries against their SQL, empty tables, and queries without SQL by brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

import oracle
from llm_brute import base_counts, tokens_of
from msgsieve.llm import catalog
from msgsieve.llm.tables import read

ALL = sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, data):
    assert oracle.compare(spark, oracle.connect(data), data, catalog.QUERIES[name], catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(name, spark, data, folder):
    tables = {t: read(spark, data, t).limit(0) for t in ("documents", "labels", "benchmark", "conversations", "pages")}
    assert catalog.QUERIES[name](spark, folder(**tables)).count() == 0


def test_all_operators_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in ALL} == set(range(1, 14))


def test_shards(spark, data):
    rows = catalog.QUERIES["op4_byte_shards"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, data, "documents").collect()}
    total = sum(len(t.encode()) + 16 for t in texts.values())
    at, slots = 0, Counter()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert r["shard"] == min(39, (2 * at + r["size"]) * 40 // (2 * total))
        assert r["slot"] == slots[r["shard"]] and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]] += 1
        at += r["size"]
    assert len(rows) == len(texts)


def test_base_counts_of_quality(spark, data):
    rows = catalog.QUERIES["op6_weak_supervision"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in rows:
        want = base_counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_packing_against_plain_tokenizer(spark, data):
    rows = catalog.QUERIES["op5_minimum_slack"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = tokens_of(texts[doc_id] or "") + [0]
        want = [(i, s, ids[s : s + 2048]) for i, s in enumerate(range(0, len(ids), 2048))]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)
        assert got == [(i, s, len(p), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))) for i, s, p in want]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


def _noise(seed, count):
    source = random.Random(seed)
    return " ".join("".join(source.choice("abcdefgh") for _ in range(5)) for _ in range(count))


@pytest.mark.parametrize("name,label,least", [("op8_levenshtein_lexicon", "toxic", 0.95), ("op9_factorization_machine", "quality", 0.95)])
def test_learned_scores_on_the_held_out_fold(name, label, least, spark, documents, folder):
    texts = []
    for i in range(300):
        body = _noise(i, 40)
        if i % 3 == 0:
            body += " gromit" + (" blorfel." if i % 2 else " Blorfl!") + " gromit " + _noise(i + 999, 5)
        if i % 4 == 0:
            body = " ".join(w + "***" for w in body.split())
        texts.append(body)
    docs = documents(*texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(300)],
                                   "doc_id bigint, quality int, toxic int")
    rows = catalog.QUERIES[name](spark, folder(documents=docs, labels=labels)).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    pairs = [(a["score"], b["score"]) for a in held for b in held if truth[a["doc_id"]] > truth[b["doc_id"]]]
    assert len(rows) == 300 and sum(a > b for a, b in pairs) >= least * len(pairs)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["op8_levenshtein_lexicon", "op9_factorization_machine"])
def test_scores_without_labels_and_of_odd_texts(name, spark, documents, folder):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents((None, "a b"), (1, None), (2, ""), (3, "x " * 50_000), (3, "x " * 50_000), (4, "\0\n\t"))
    rows = catalog.QUERIES[name](spark, folder(documents=docs, labels=labels)).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
