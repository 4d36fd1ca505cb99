"""Behaviour users meet first: normal forms, filters on loaded fields, caches, datasets' odd rows, services, reports, samples."""

import io
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import encoding, generation, retrieval
from passagework.plans import config as C
from passagework.plans.evaluate import ablation_markdown, save_ablation
from passagework.plans.pipeline import Pipeline
from passagework.plans.registry import registry
from passagework.sources import datasets, loaders, samples
from passagework.sources.knowledge_base import KnowledgeBase


def test_nfkc_is_the_default(spark):
    rows = spark.createDataFrame([(1, "\ufb01ne \u2460 e\u0301tat \uff21\uff22"), (2, "\u00e9tat plain"), (3, None), (4, "\uf900")], "k int, text string")
    got = {r["k"]: r["t"] for r in rows.select("k", T.tokens(F.col("text")).alias("t")).collect()}
    assert got == {1: ["fine", "1", "tat", "ab"], 2: ["tat", "plain"], 3: [], 4: ["\u8c48"]}
    assert rows.select(T.tokens(F.col("text"), exact=False).alias("t")).first()[0] == ["ne", "e", "tat", "ab"]
    many = spark.createDataFrame([(["\ufb01", None, "x"],), ([],)], "a array<string>")
    assert [r[0] for r in many.select(T.nfkc_each(F.col("a"))).collect()] == [["fi", "", "x"], []]


def test_searches_with_and_without_tables_agree(spark):
    docs = spark.createDataFrame([(k, " ".join(np.random.default_rng(k).choice(list("abcdefgh"), 12))) for k in range(40)] + [(40, ""), (41, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "b c d"), (2, "g"), (3, "zzz")], "query_id int, question string")
    post = retrieval.postings(docs)
    tables = retrieval.bm25_top_k(q, post, retrieval.term_stats(post), retrieval.corpus_stats(docs), 5)
    rows = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in d.collect())
    assert rows(tables) == rows(retrieval.bm25_search(q, docs, 5)) and len(rows(tables)) == 10


def test_dense_search_in_blocks_and_tiles(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = [(k, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(300)]
    vectors, queries = spark.createDataFrame(v, "chunk_id long, vector array<double>").repartition(4), spark.createDataFrame(v[:30], "query_id long, vector array<double>")
    m = np.array([x for _, x in v])
    want = []
    for k in range(30):
        s = m @ m[k]
        want += [(k, n + 1, int(c), float(s[c])) for n, c in enumerate(np.lexsort((np.arange(300), -s))[:7])]
    rows = lambda d: sorted((x["query_id"], x["rank"], x["chunk_id"], x["score"]) for x in d.collect())
    assert rows(retrieval.dense_top_k(queries, vectors, 7)) == want
    monkeypatch.setattr(retrieval, "TILE", 20_000)  # two queries at a time
    assert rows(retrieval.dense_top_k(queries, vectors, 7, block_bytes=300)) == want


def test_fusion_of_channels_with_one_source(spark):
    schema = "query_id int, chunk_id string, rank int, score double, source string"
    a, b = spark.createDataFrame([(1, "x", 1, 0.9, "vector")], schema), spark.createDataFrame([(1, "x", 1, 0.4, "vector"), (1, "y", 2, 0.3, "bm25")], schema)
    got = {r["chunk_id"]: r["debug"] for r in retrieval.rrf([a, b], 5).collect()}
    assert got == {"x": {"vector": 0.9}, "y": {"bm25": 0.3}}


def test_filters_on_loaded_fields(spark, tmp_path):
    rows = [{"id": f"c{y}", "text": f"text {y}", "year": y, "open": y > 2023} for y in (2023, 2024, 2025)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    docs = loaders.jsonl(spark, str(tmp_path / "c.jsonl"))
    found = lambda **where: {r["doc_id"] for r in docs.where(retrieval.matches(where, docs.columns)).collect()}
    assert found(year=2024) == {"c2024"} and found(year=[2024, 2025]) == {"c2024", "c2025"} and found(open=True, doc_id="c2025") == {"c2025"}
    assert found(nothing=1) == set() and len(found(nothing=None)) == 3


def test_containing_agrees_with_all_pairs(spark):
    r = np.random.default_rng(2)
    words = ["ab", "abc", "b", "cab", "x"]
    texts = [" ".join(r.choice(words, r.integers(1, 40))) for _ in range(60)] + ["", None]
    items = [t[2:] for t in texts[:10]] + [texts[k][3:40] for k in range(10, 25)] + ["ab", "", "b x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = retrieval.containing(docs, spark.createDataFrame(list(enumerate(items)), "item_id int, item string"))
    assert sorted((x["item_id"], x["doc_id"]) for x in got.select("item_id", "doc_id").collect()) == sorted((i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if t is not None and x in t)


def test_scalar_answers_and_dataset_folders(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps({"id": k, "question": "q", "answers": a}) for k, a in enumerate(["[1] foo", ["a", "[b]"], None, 7, []])))
    got = {r["sample_id"]: r["answers"] for r in datasets.JsonlDataset(spark, str(tmp_path / "qa.jsonl")).samples().collect()}
    assert got == {"0": ["[1] foo"], "1": ["a", "[b]"], "2": [], "3": ["7"], "4": []}
    beir = tmp_path / "sets" / "one"
    (beir / "qrels").mkdir(parents=True)
    (beir / "corpus.jsonl").write_text('{"_id": "d", "title": "", "text": "x"}\n')
    (beir / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n')
    (beir / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\nq\te\t0\n")
    assert datasets.probe(spark, str(beir)) == {"kind": "beir_style", "rows": 1, "fields": ["_id", "text", "title"], "splits": {"test": 2}}
    assert [x["kind"] for x in datasets.scan(spark, str(tmp_path)).values()] == ["jsonl", "beir_style"]


def test_configuration_values():
    assert C.expand(["${A}", "${B:--2.5}", "${C:-x1}"], {"A": "-5"}) == [-5, -2.5, "x1"]
    assert C.merge({"r": {"k": 1}}, {"r": {"type": "x"}}) == {"r": {"k": 1, "type": "x"}}
    assert C.merge({"r": {"type": "x", "k": 1}}, {"r": {"type": "x", "n": 2}}) == {"r": {"type": "x", "k": 1, "n": 2}}


def test_rerank_addresses_and_tries():
    calls = []

    def post(url, body):
        calls.append((url, body))
        raise OSError("down")

    make = lambda base, **kw: generation.HttpReranker("m", base, post=post, sleep=lambda s: None, **kw)
    assert make("http://dashscope/api/v1").order("q", ["a"], 5) is None and len(calls) == 2
    assert calls[0][0] == "http://dashscope/api/v1/services/rerank/text-rerank/text-rerank" and calls[0][1]["parameters"]["top_n"] == 1
    make("http://x/v1/", endpoint="own/path", max_retries=1).order("q", ["a", "b"], 1)
    assert len(calls) == 3 and calls[2][0] == "http://x/v1/own/path" and calls[2][1]["top_n"] == 1


def test_error_details():
    error = lambda body: urllib.error.HTTPError("http://x", 429, "Too Many", {}, io.BytesIO(body))
    assert encoding.http_detail(error(b'{"error": {"message": "slow down"}}')) == "slow down"
    assert encoding.http_detail(error(b"plain")) == "plain" and encoding.http_detail(error(b"")) == "Too Many"


def test_cached_encoder_in_a_knowledge_base(spark, tmp_path):
    class Counting:
        """Writes each text it encodes to a file, as workers are other processes."""

        def __init__(self, path):
            self.path = path

        def encode(self, texts, is_query=False):
            with open(self.path, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float("nan") if t == "bad" else 1.0, 0.0] for t in texts]

    docs = loaders.memory(spark, [("a", "one"), ("b", "two"), ("c", "one")])
    make = lambda: KnowledgeBase(spark, {"kind": "fixed", "size": 50, "overlap": 0}, {"type": "own", "object": Counting(str(tmp_path / "seen")), "cache": str(tmp_path / "cache")})
    assert make().add(docs).chunks.where("vector is not null").count() == 3
    assert make().add(docs).chunks.count() == 3
    assert sorted((tmp_path / "seen").read_text().split()) == ["one", "two"]
    plain = KnowledgeBase(spark, {"kind": "fixed", "size": 50, "overlap": 0}, {"type": "own", "object": Counting(str(tmp_path / "seen")), "dimension": 3})
    with pytest.raises(Exception, match="bad vector"):
        plain.add(docs).chunks.collect()
    bad = KnowledgeBase(spark, {"kind": "fixed", "size": 50, "overlap": 0}, {"type": "own", "object": Counting(str(tmp_path / "seen"))})
    with pytest.raises(Exception, match="bad vector"):
        bad.add(loaders.memory(spark, [("a", "bad")])).chunks.collect()


def test_timings_namespaces_and_missing_packages(spark):
    p = Pipeline(spark, C.DEFAULTS).index(loaders.memory(spark, [("d1", "the RRF constant is 60", {})]))
    answers, hits = p.answer(spark.createDataFrame([("q", "what is the RRF constant")], "query_id string, question string"))
    assert "60" in answers.first()["text"] and hits.first()["doc_id"] == "d1"
    assert {"retrieve", "rerank", "generate", "total"} <= set(p.timings)
    assert {"source", "dataset", "metric"} <= set(registry.options()) and "jsonl" in registry.options("source") and "ndcg" in registry.options("metric")
    with pytest.raises(ImportError, match="surely_missing"):
        registry.need("surely_missing", "encoder x")


def test_ablation_files(spark, tmp_path):
    rows = spark.createDataFrame([("3", "recall@3", 0.5, 0.0), ("5", "recall@5", 0.75, 0.25)], "variant string, metric string, value double, delta double")
    save_ablation(str(tmp_path / "out"), "top_k", rows, ["10: no"])
    assert json.loads((tmp_path / "out" / "top_k.json").read_text())["skipped"] == ["10: no"]
    assert "| 5 | 0.7500 (+0.2500) |" in ablation_markdown("top_k", rows, [])


def test_samples(spark, tmp_path):
    samples.write_samples(spark, str(tmp_path), True)
    samples.write_tool_samples(spark, str(tmp_path))
    n = len(samples.DOCS)
    hard = loaders.jsonl(spark, str(tmp_path / "corpus_hard.jsonl"))
    assert loaders.jsonl(spark, str(tmp_path / "corpus.jsonl")).count() == n and hard.count() == 5 * n
    qa = datasets.JsonlDataset(spark, str(tmp_path / "qa.jsonl"), str(tmp_path / "corpus.jsonl")).samples().collect()
    held = {r["doc_id"]: r["text"] for r in hard.collect()}
    assert all(a in held[r["gold_doc_ids"][0]] for r in qa for a in r["answers"])
    files = loaders.jsonl(spark, str(tmp_path / "files.jsonl"))
    assert {r["doc_id"] for r in files.where(retrieval.matches({"year": 2025}, files.columns)).collect()} == {"tariff_new"}
