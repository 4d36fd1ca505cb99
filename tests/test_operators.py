"""Operators on small rows, with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import chunking, encoding, generation, metrics, retrieval


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).first()[0]


@pytest.mark.parametrize("exact", [False, True])
def test_normalize(spark, exact):
    assert col(spark, "　Hello, World！ ", lambda c: T.normalize(c, exact)) == "hello world"
    assert col(spark, None, lambda c: T.normalize(c, exact)) == ""


def test_tokens(spark):
    assert col(spark, "RAG 很好 2024", T.tokens) == ["rag", "很", "好", "2024"]
    assert col(spark, "机器学习", T.index_tokens) == ["机", "器", "学", "习", "机器", "器学", "学习"]
    assert col(spark, "The état of 机。器", T.index_tokens) == ["tat", "机", "器", "机器"]


@pytest.mark.parametrize("text,grams", [("Ab cD", ["abc", "bcd"]), ("ab", ["ab"]), ("", []), (None, [])])
def test_char_ngrams(spark, text, grams):
    assert col(spark, text, T.char_ngrams) == grams


def pieces(spark, text, *args):
    rows = chunking.chunk(spark.createDataFrame([("d", text)], "doc_id string, text string"), *args).orderBy("position").collect()
    return [r["text"] for r in rows], [r["chunk_id"] for r in rows]


def test_chunkers(spark):
    assert pieces(spark, "abcdefghij", "fixed", 4, 1)[0] == ["abcd", "defg", "ghij", "j"]
    assert pieces(spark, "aaaaaaaa。bbbbbbbb。", "recursive", 10, 3)[0] == ["aaaaaaaa。", "aa。bbbbbbbb。", "bb。"]
    assert pieces(spark, "intro\n# A\nx\n### B\ny", "markdown", 100, 10)[0] == ["[A]\nx", "[A > B]\ny"]
    many, ids = pieces(spark, "句子一。" * 200, "recursive", 100, 20)
    assert len(many) > 1 and max(map(len, many)) <= 130 and ids == pieces(spark, "句子一。" * 200, "recursive", 100, 20)[1]
    assert pieces(spark, "abc", "fixed", 10, 2)[1] == ["d#0-90015098"]
    assert pieces(spark, None, "recursive", 10, 2)[0] == []
    with pytest.raises(ValueError):
        chunking.check_sizes(10, 10)


def test_hashing(spark):
    df = spark.createDataFrame([("abc",)], "f string")
    assert tuple(df.select(encoding.bucket(F.col("f"), 512), encoding.sign(F.col("f")), encoding.bucket(F.col("f"), 300)).first()) == (370, 1, 70)
    rows = spark.createDataFrame([(1, "向量检索很重要"), (2, "向量检索非常重要"), (3, "今天天气不错"), (4, "")], "k int, text string")
    v = {r[0]: np.array(r[1]) for r in encoding.densify(encoding.hash_vectors(rows, "k", 256), "k", 256).collect()}
    assert 4 not in v and all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert v[1] @ v[2] > v[1] @ v[3]


def test_bm25(spark):
    docs = spark.createDataFrame([("d0", "cat cat dog"), ("d1", "dog fish")], "chunk_id string, text string")
    post = retrieval.postings(docs)
    q = spark.createDataFrame([(1, "cat"), (2, "dog dog")], "query_id int, question string")
    hits = retrieval.bm25_top_k(q, post, retrieval.term_stats(post), retrieval.corpus_stats(docs), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in hits] == [(1, "d0"), (2, "d1"), (2, "d0")]
    assert [r["score"] for r in hits] == pytest.approx([0.930399, 0.200354, 0.167268], abs=1e-6)


def ranked(spark, names, source="x"):
    return spark.createDataFrame([(1, i + 1, n, 1.0, source) for i, n in enumerate(names)], "query_id int, rank int, chunk_id string, score double, source string")


def test_rrf(spark):
    out = retrieval.rrf([ranked(spark, "ABC"), ranked(spark, "BD", "y")], 5).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in out] == [("B", 0.032522), ("A", 0.016393), ("D", 0.016129), ("C", 0.015873)]
    assert [r["chunk_id"] for r in retrieval.rrf([ranked(spark, "A"), ranked(spark, "B")], 5).orderBy("rank").collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        retrieval.rrf([ranked(spark, "A")], 5, [1.0, 2.0])


def test_max_merge(spark):
    rows = spark.createDataFrame([(1, 0, 1, "A", 0.5, "s"), (1, 0, 2, "B", 0.4, "s"), (1, 1, 1, "B", 0.9, "s")], "query_id int, variant int, rank int, chunk_id string, score double, source string")
    assert [(r["chunk_id"], r["score"]) for r in retrieval.max_merge(rows, 5).orderBy("rank").collect()] == [("B", 0.9), ("A", 0.5)]


def test_rerank_lexical(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "the")], "query_id int, question string")
    text = "alpha beta " + "x" * 189
    hits = spark.createDataFrame([(1, 1, "c", text, 0.0, "s"), (2, 1, "c", text, 0.0, "s"), (2, 2, "e", "alpha", 9.0, "s")], "query_id int, rank int, chunk_id string, text string, score double, source string")
    out = {(r["query_id"], r["rank"]): r for r in retrieval.rerank_lexical(q, hits, 5).collect()}
    assert math.isclose(out[1, 1]["score"], 0.47) and out[1, 1]["source"] == "rerank:lexical"
    assert [out[2, k]["chunk_id"] for k in (1, 2)] == ["c", "e"]


def test_dense_spaces_and_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "chunk_id long, vector array<float>, year int").repartition(5)
    queries = vectors.where("chunk_id < 4").select(F.col("chunk_id").alias("query_id"), "vector")
    orders = {}
    for space in retrieval.SPACES:
        for block in (1 << 20, 64):
            out = retrieval.dense_top_k(queries, vectors, 7, space, block_bytes=block).orderBy("query_id", "rank").collect()
            orders[space, block] = [(r["query_id"], r["chunk_id"]) for r in out]
    first = next(iter(orders.values()))
    assert len(first) == 28 and all(o == first for o in orders.values())
    assert first[:7] == [(0, int(i)) for i in np.argsort(-(v @ v[0]), kind="stable")[:7]]
    only = retrieval.dense_top_k(queries, vectors, 50, where={"year": [0, 1]}).select("chunk_id").distinct().collect()
    assert all(r[0] % 3 < 2 for r in only)
    found = retrieval.lsh_top_k(queries, vectors, 1).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in found} == {(i, i) for i in range(4)}


def test_lsh_recall(spark):
    """Of the true neighbours other than the query itself at least 0.9 are found; repeated vectors and ids keep exact scores."""
    v = np.random.default_rng(1).standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>")
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    pairs = lambda df: {(r["query_id"], r["chunk_id"]): r["score"] for r in df.where("query_id <> chunk_id").collect()}
    want, rows = pairs(retrieval.dense_top_k(queries, vectors, 5)), retrieval.lsh_top_k(queries, vectors, 5)
    got = pairs(rows)
    assert len(want) == 80 and len(want.keys() & got.keys()) / len(want) >= 0.9
    assert all(math.isclose(got[p], want[p], abs_tol=1e-8) for p in want.keys() & got.keys())
    assert rows.select("query_id", "chunk_id").distinct().count() == 100


def test_bad_vectors(spark):
    bad = spark.createDataFrame([("a", [1.0, float("nan")])], "chunk_id string, vector array<float>")
    with pytest.raises(Exception, match="bad vector"):
        retrieval.check_vectors(bad, 2).collect()


def test_metadata_filter(spark):
    rows = spark.createDataFrame([(1, 2025), (2, 2024), (3, None)], "c int, year int")
    assert [r[0] for r in rows.where(retrieval.matches({"year": 2024})).collect()] == [2]
    assert [r[0] for r in rows.where(retrieval.matches({"year": [2024, 2025]})).collect()] == [1, 2]
    assert [r[0] for r in rows.where(retrieval.matches({"year": None})).collect()] == [3]


def hits_of(spark, texts):
    return spark.createDataFrame([(1, i + 1, f"c{i + 1}", "d", t) for i, t in enumerate(texts)], "query_id int, rank int, chunk_id string, doc_id string, text string")


def test_pack_contexts(spark):
    head = len(generation.BLOCK_HEADER % (1, "d"))
    one = generation.pack_contexts(hits_of(spark, ["a" * (20 - head + 20), "b" * 15, "c"]), 30 + 20).first()
    assert one["used"] == ["c1"]
    assert len(generation.pack_contexts(hits_of(spark, ["a" * 90]), 30).first()["context"]) == 30


def test_citations(spark):
    got = spark.createDataFrame([("x [2][1][2][9]", ["c1", "c2"])], "t string, u array<string>").select(generation.citations(F.col("t"), F.col("u"))).first()[0]
    assert got == ["c2", "c1"]


def test_extractive(spark):
    q = spark.createDataFrame([(1, "rrf constant"), (2, "nothing")], "query_id int, question string")
    out = {r["query_id"]: r for r in generation.extractive(q, hits_of(spark, ["the RRF constant is 60!\nother words"]), 1).collect()}
    assert "60" in out[1]["text"] and out[1]["citations"] == ["c1"] and out[2]["text"] == generation.NO_EVIDENCE_EXTRACTIVE


def test_stuff_and_rewriting(spark):
    q = spark.createDataFrame([(1, "why"), (2, "no hits")], "query_id int, question string")
    out = {r["query_id"]: r for r in generation.stuff(q, hits_of(spark, ["text"]), generation.Echo("> ")).collect()}
    assert out[1]["raw"].startswith("> ") and out[2]["text"] == generation.NO_EVIDENCE_STUFF

    class Lines(generation.Echo):
        def chat(self, messages, **options):
            if "no hits" in messages[-1]["content"]:
                raise OSError("down")
            return "one\n\n two \nthree\nfour"

    got = generation.transform_queries(q, "multi_query", Lines(), 2).orderBy("query_id", "variant").collect()
    assert [(r["query_id"], r["question"]) for r in got] == [(1, "why"), (1, "one"), (1, "two"), (2, "no hits")]
    assert generation.transform_queries(q, "hyde", Lines(), keep_original=False).where("query_id = 2").first()["question"] == "no hits"


def test_http_clients():
    calls = []

    def post(url, body):
        calls.append((url, body))
        return {"results": [{"index": 1, "relevance_score": 0.95}, {"index": 2, "relevance_score": 0.4}, {"index": 9, "relevance_score": 1}]}

    assert generation.HttpReranker("m", "http://x/v1", post=post).order("q", ["a", "b", "c"], 2) == [(1, 0.95), (2, 0.4)]
    assert calls[0][0] == "http://x/v1/rerank" and calls[0][1]["documents"] == ["a", "b", "c"]
    assert generation.api_results({"output": {"results": [1]}}) == [1] and generation.api_results({"data": [2]}) == [2]

    def broken(url, body):
        raise OSError("down")

    assert generation.HttpReranker("m", "http://x/v1", post=broken, sleep=lambda s: None).order("q", ["a"], 1) is None
    chat = generation.HttpChat("m", "http://x", post=lambda u, b: {"choices": [{"message": {"content": b["model"]}}]})
    assert chat.ask("hi", model="other") == "other"
    with pytest.raises(RuntimeError):
        generation.HttpChat("m", "http://x", post=broken, sleep=lambda s: None).ask("hi")
    sizes = []

    def limited(url, body):
        sizes.append(len(body["input"]))
        if len(body["input"]) > 2:
            import urllib.error

            raise urllib.error.HTTPError(url, 413, "too large", {}, None)
        return {"data": [{"index": i, "embedding": [3.0, 4.0]} for i in range(len(body["input"]))]}

    enc = encoding.HttpEncoder("m", "http://x", batch_size=4, post=limited, sleep=lambda s: None)
    assert np.allclose(enc.encode(["a", "", "c", "d", "e"]), [[0.6, 0.8]] * 5) and enc.batch_size == 2


def test_cached_encoder(spark):
    class Unit:
        def encode(self, texts, is_query=False):
            return [[1.0, 0.0]] * len(texts)

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, text string")
    first, cache = encoding.encode_cached(rows, "k", Unit(), None, "cfg")
    assert cache.count() == 2 and first.count() == 3
    again, grown = encoding.encode_cached(rows.union(spark.createDataFrame([(4, "c")], rows.schema)), "k", Unit(), cache, "cfg")
    assert grown.count() == 3 and again.count() == 4


def table(spark, gold, docs, answers=("x",)):
    s = spark.createDataFrame([("s", "q", list(answers), gold)], "sample_id string, question string, answers array<string>, gold_doc_ids array<string>")
    h = spark.createDataFrame([("s", i + 1, d, d) for i, d in enumerate(docs)], "sample_id string, rank int, doc_id string, text string")
    return s, h


def values(df):
    return {r["metric"]: round(r["value"], 6) for r in df.collect()}


def test_retrieval_metrics(spark):
    assert values(metrics.retrieval_metrics(*table(spark, ["d1", "d2"], ["x", "d1", "x", "d2", "y"]), 5)) == {"recall@5": 1, "precision@5": 0.5, "hit_rate@5": 1, "mrr@5": 0.5, "map@5": 0.583333, "ndcg@5": 0.693426}
    assert values(metrics.retrieval_metrics(*table(spark, ["d1", "d2"], ["d1", "x", "y"]), 3))["recall@3"] == 0.5
    assert values(metrics.retrieval_metrics(*table(spark, ["d1"], []), 3))["precision@3"] == 0
    assert values(metrics.retrieval_metrics(*table(spark, [], ["x"]), 3)) == {}


def answered(spark, gold, pred):
    s, _ = table(spark, [], [], [gold])
    return s, spark.createDataFrame([("s", pred, ["c"])], "sample_id string, text string, citations array<string>")


def test_answer_metrics(spark):
    f1 = values(metrics.token_f1(*answered(spark, "北京 是 首都", "北京是中国的首都")))
    assert f1 == {"token_f1": 0.769231, "token_precision": 0.625, "token_recall": 1.0}
    assert values(metrics.rouge_l(*answered(spark, "abc def ghi", "abc def ghi"))) == {"rouge_l": 1.0}
    assert values(metrics.rouge_l(*answered(spark, "abc def ghi", "ghi def abc"))) == {"rouge_l": 0.333333}
    assert values(metrics.exact_match(*answered(spark, "A b.", "a B"))) == {"exact_match": 1.0}
    assert values(metrics.answer_contains(*answered(spark, "b c", "a b c d"))) == {"answer_contains": 1.0}
    assert values(metrics.token_f1(*answered(spark, "", "x"))) == {}
    s, h = table(spark, [], ["the catalog"], ["a cat"])
    assert values(metrics.context_recall(s, h)) == {"context_recall": 1.0, "answer_in_context": 0.0}
    a = spark.createDataFrame([("s", "a cat", [])], "sample_id string, text string, citations array<string>")
    assert values(metrics.faithfulness(s, h, a)) == {"faithfulness": 0.0, "citation_rate": 0.0}


def test_lcs_against_table():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert metrics.lcs(a, b) == t[-1, -1]


def test_summary_and_delta(spark):
    scores = spark.createDataFrame([("1", "m", 1.0), ("2", "m", 0.0), ("3", "other", 1.0)], "sample_id string, metric string, value double")
    assert {(r["metric"], r["value"], r["n"]) for r in metrics.summary(scores).collect()} == {("m", 0.5, 2), ("other", 1.0, 1)}
    rows = spark.createDataFrame([("a", "recall@5", 0.8), ("b", "recall@10", 0.9)], "variant string, metric string, value double")
    assert {r["variant"]: r["delta"] for r in metrics.delta(rows, "a").collect()} == {"a": 0.0, "b": 0.1}
    assert metrics.parse_judgement('why\n{"correctness":1,"faithfulness":0.5,"relevance":0}')["judge_faithfulness"] == 0.5
    assert metrics.parse_judgement("no") is None
