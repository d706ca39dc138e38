"""Token alignment, resampling and URL rules on small tables, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import oracle
from llm_brute import by_id
from msgsieve.llm import alignment, resampling, url_rules
from msgsieve.llm.tables import read

ODD = [None, "", "日本" * 400, "ÿ́" * 300, " \n\t ", "one", "é ß　x", "a\n\na\na", "w " * 30_000, "w " * 30_000, "\0 b", "▁under", "<|endoftext|> </s> <unk>",
       "日本語のテキスト 🙂🙂", "x" * 60_000, "a  b   c", "ﬁ"]


# 11 Token alignment

@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.tokenizer_paths())


def plain_alignment(aligner, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, link by link."""
    found, held = [], Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        a = aligner.tokenizer_a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = aligner.tokenizer_b.encode(text or "")
        ends = []
        for ids, tokens in ((a, aligner.a), (b, aligner.b)):
            total, own = 0, []
            for i in ids:
                total += len(tokens.raw[i])
                own.append(total)
            ends.append(own)
        if not text or b"".join(aligner.a.raw[i] for i in a) != raw or b"".join(aligner.b.raw[i] for i in b) != raw:
            found.append((0, 0, 0, Counter(), ""))
            continue
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(line.encode()).hexdigest()))
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(n, highest.get(x, 0))
    return [(n_a, n_b, n_groups, sum(links.values()), sum(m for p, m in links.items() if held[p] == highest[p[0]]),
             sum(m * held[p] for p, m in links.items()), digest) for n_a, n_b, n_groups, links, digest in found]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk_pairs", [1, 40, 300_000])
def test_alignment_against_plain_version(chunk_pairs, spark, documents, aligner):
    got = by_id(alignment.align(documents(*ODD), *alignment.tokenizer_paths(), chunk_pairs), *ALIGNED)
    assert [got[i] for i in range(len(ODD))] == plain_alignment(aligner, ODD)


def test_alignment_of_whole_table(spark, data, aligner):
    rows = alignment.op11_token_alignment(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}
    ids = list(docs)
    want = dict(zip(ids, plain_alignment(aligner, [docs[i] for i in ids])))
    assert {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in rows} == want


def test_alignment_of_repeated_rows_and_clashing_columns(spark, documents):
    docs = documents((None, "a b"), (1, "a b"), (1, "a b"), (1, "a c")).selectExpr("*", "1 AS chunk", "2 AS n", "'x' AS pair")
    rows = alignment.align(docs, *alignment.tokenizer_paths()).collect()
    assert sorted((r["doc_id"] or 0, r["count_sum"]) for r in rows) == [(0, 7), (1, 5), (1, 7), (1, 7)]


@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=80))
@settings(max_examples=300, deadline=None)
def test_latin_texts_have_the_ids_of_the_vocabularys_own_library(text):
    own = _cached_aligner()
    assert own.latin_a.encode_ordinary(" " + text) == own.tokenizer_a.encode(" " + text, add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.sampled_from("aé  ▁\n\t'.1日🙂<|>s\x1c\u3000\xa0"), st.characters(codec="utf-8")), min_size=1, max_size=60))
@settings(max_examples=500, deadline=None)
def test_windows_join_to_all_ids(text):
    own = _cached_aligner()
    a = own.tokenizer_a.encode(" " + text, add_special_tokens=False).ids
    b = own.tokenizer_b.encode(text)
    numbers, = own.windows([text])
    assert (numbers is None) == (own.a.join(a) != b" " + text.encode() or own.b.join(b) != b" " + text.encode())
    if numbers is not None:
        windows = list(own.numbers)
        keys = [windows[n] for n in numbers]
        assert [x for k in keys for x in k[0]] == a and [x for k in keys for x in k[1]] == b
        assert all(own.a.join(x) == own.b.join(y) and own.a.spaced[x[0]] and own.b.spaced[y[0]] for x, y in keys)
        assert [own.known[n] for n in numbers] == [own.align([k])[0] for k in keys]


def test_few_windows_are_kept(monkeypatch):
    own = alignment.Aligner(*alignment.tokenizer_paths())
    texts = [f"a b{i} c ▁ {i}" if i % 3 else f"d{i} e" for i in range(40)]
    want = own.documents(texts)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 5)
    for _ in range(2):
        got = [figures for low in range(0, 40, 7) for figures in own.documents(texts[low : low + 7])]
        assert [[str(x) for x in f] for f in got] == [[str(x) for x in f] for f in want]
        assert len(own.known) == len(own.numbers) <= 5 >= len(set(own.stretches.values()))


def test_long_windows_do_not_fill_a_worker(monkeypatch):
    """Texts without spaces are a window each; few of them are kept, and none whose bytes come out unequal."""
    own = alignment.Aligner(*alignment.tokenizer_paths())
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) + f" a{i}" for i in range(30)] + ["▁under" * 9, "plain words"]
    want = own.documents(texts)
    assert any(not f[0] for f in want) and all(own.stretches.get(s, 0) is not None for s in own.stretches)
    monkeypatch.setattr(alignment, "KEPT_IDS", 3_000)
    own = alignment.Aligner(*alignment.tokenizer_paths())
    for _ in range(2):
        got = [figures for low in range(0, 32, 5) for figures in own.documents(texts[low : low + 5])]
        assert [[str(x) for x in f] for f in got] == [[str(x) for x in f] for f in want]
        assert sum(len(w[4]) + w[0] + w[1] for w in own.known) <= 3_000
        assert 0 < len(own.known) == len(own.numbers) == len(own.stretches)


def test_chunks_are_written_and_read_few_at_a_time(spark, documents, aligner, monkeypatch):
    """A chunk is a large row; no row group holds all of a task's, and lists of a chunk's counts are gathered piece by piece."""
    written, real = [], alignment.cut_lineage
    monkeypatch.setattr(alignment, "cut_lineage", lambda df, name, **o: written.append((name, real(df, name, **o))) or written[-1][1])
    monkeypatch.setattr(alignment, "GATHERED", 3)
    texts = [*ODD, *(f"many words {i} in {i * i} texts" for i in range(30)), " ".join(f"w{i}" for i in range(300))]
    got = by_id(alignment.align(documents(*texts).coalesce(1), *alignment.tokenizer_paths(), 40), *ALIGNED)
    assert [got[i] for i in range(len(texts))] == plain_alignment(aligner, texts)
    files = [f.removeprefix("file:").removeprefix("//") for f in dict(written)["aligned"].inputFiles()]
    sizes = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(sizes) > 20 and max(sizes) <= alignment.CHUNKS_A_GROUP


_aligners = []


def _cached_aligner():
    if not _aligners:
        _aligners.append(alignment.Aligner(*alignment.tokenizer_paths()))
    return _aligners[0]


def test_token_map_takes_the_pair_of_most_documents(spark):
    rows = [(1, 10, 5, True), (1, 9, 5, True), (1, 8, 3, False), (2, 4, 1, True)]
    counts = spark.createDataFrame(rows, "id_a bigint, id_b bigint, n bigint, best boolean")
    assert sorted(map(tuple, alignment.token_map(counts).collect())) == [(1, 9), (2, 4)]


# 12 Resampling

def plain_features(text, grams=2):
    words = "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " "
                    for c in (text or "").translate({i: i + 32 for i in range(65, 91)})).split(" ")
    words = [w for w in words if w]
    return words, [" ".join(words[i:i + n]).encode() for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


@given(st.text(alphabet="aBz09 é日\n-_Z\0", max_size=60), st.integers(1, 4))
@settings(deadline=None)
def test_chained_checksums(text, grams):
    words, runs = plain_features(text, grams)
    assert resampling.words_of(text.encode()) == [w.encode() for w in words]
    assert sorted(resampling.checksums(resampling.words_of(text.encode()), grams)) == sorted(map(zlib.crc32, runs))


def plain_resampling(docs, target, percent):
    source, wanted = Counter(), Counter()
    for texts, total in ((docs.values(), source), (target, wanted)):
        for text in texts:
            total.update(zlib.crc32(f) % 10_000 for f in plain_features(text)[1])
    s, t = sum(source.values()) + 10_000, sum(wanted.values()) + 10_000
    found = {}
    for doc_id, text in docs.items():
        words, runs = plain_features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * t ** -1 * s / (source[b] + 1)))
                for b in (zlib.crc32(f) % 10_000 for f in runs)]
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        found[doc_id] = [len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)]
    order = sorted((i for i in found if found[i][4] >= 20), key=lambda i: (-found[i][2], i))
    for rank, i in enumerate(order[: percent * len(order) // 100], 1):
        found[i][3] = rank
    return {i: tuple(f[:4]) for i, f in found.items()}


def prose(seed, count):
    source = random.Random(seed)
    return " ".join(f"w{source.randrange(300)}" for _ in range(count))


def test_resampling_against_plain_version(spark, documents):
    texts = [*ODD, *(prose(i, 15 + i % 12) for i in range(120))]
    target = [prose(7, 200), None, "w5 w6 " * 40]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    docs = documents(*texts).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("part", F.lit(0))
    got = by_id(resampling.resample(docs, items), "n_features", "weight", "score", "rank")
    assert got == plain_resampling(dict(enumerate(texts)), target, 25)


def test_resampling_ties_nulls_and_an_empty_target(spark, documents):
    same = prose(1, 30)
    docs = documents((None, same), *[(3, same)] * 5, (4, None), (5, "a b"))
    rows = resampling.resample(docs, docs.limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3] and len(rows) == 8
    assert len({(r["weight"], r["score"]) for r in rows if r["doc_id"] == 3}) == 1
    assert resampling.drawn_documents(documents((1, same), (2, same)), spark.createDataFrame(
        [(1, 1), (2, None)], "doc_id bigint, rank bigint")).count() == 1


# 13 URL rules

URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET", "http://A.Example.NET/", "https://example.net/en/1",
        "https://sub.example.net/en/x?q=1#f", "https://badexample.net/en/x", "http://x.org/fr", "http://x.org/fr/", "http://org/fr/2",
        "http://example.com/de/a/b", "http://example.com#/de/", "ftp://h?x=://y/z", "http://h/a\nb?c", "http://a.net:80/x",
        "x" * 50_000, "http://" + "a." * 20_000 + "net/" + "p/" * 20_000]


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    path = rest[len(host):]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def test_listed_rules_against_plain_version(spark):
    got = {r["page_id"]: r for r in url_rules.judge(pages_of(spark, URLS)).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        fits = [(rule, v) for rule, v in url_rules.RULES
                if ("." + host).endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/"):])]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert rule is None or got[i]["verdict"] == verdict


def test_mined_rules_equal_sql(spark, folder):
    source = random.Random(3)
    urls = [f"{source.choice(['http', 'https'])}://{source.choice(['m', 'www', 'blog'])}.{source.choice(['a', 'b', 'c'])}."
            f"example.{source.choice(['com', 'net', 'org'])}/{source.choice(['de', 'en', 'fr', 'es'])}/{i}/{source.choice(['ad', 'buy', 'x'])}"
            f"{source.choice(['', '?ref=x', '?utm_source=feed#top'])}" for i in range(600)]
    where = folder(pages=pages_of(spark, [*URLS, *urls]).withColumn("verdict", F.lit(1)).withColumn("tokens", F.lit(2)))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{where}/pages.parquet/*.parquet')")
    assert oracle.compare(spark, con, where, url_rules.op13_association_rules, url_rules.SQL) == ""


def test_a_deep_path_shared_by_a_site_is_one_item(spark):
    deep = "/".join(f"part{chr(97 + i)}" for i in range(26))  # 2^26 frequent sets if each were an item
    judged = [(f"http://bad.example/{deep}/{i}", "block") for i in range(40)] + [(f"http://good.example/x/{i}", "allow") for i in range(60)]
    judged = spark.createDataFrame(judged, "url string, verdict string")
    rules, items = url_rules.mine(judged)
    assert items.count() == 31 and items.select("item").distinct().count() <= 4
    pages = pages_of(spark, ["http://other/partq", "http://other/x", "http://other/y", None])
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, (), judged).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow"}


def test_pruning_by_support_confidence_and_parts(spark):
    rows = [("http://h/a/b", "block")] * 8 + [("http://h/a/c", "block")] * 2 + [("http://h/c/d", "allow")] * 9 + [("http://h/e", "block")]
    rules, _ = url_rules.mine(spark.createDataFrame(rows, "url string, verdict string"), support=0.1, confidence=0.8)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    assert got == {(("path:a",), "block"): 1.0, (("path:b",), "block"): 1.0, (("path:d",), "allow"): 1.0, (("path:c",), "allow"): 9 / 11}


def test_nothing_judged(spark):
    judged = spark.createDataFrame([("http://a/b", None)], "url string, verdict string")
    rows = url_rules.judge(pages_of(spark, ["http://x.net/a", None]), (), judged).collect()
    assert [r["verdict"] for r in rows] == ["allow", "allow"] and all(r["rule"] is None for r in rows)
