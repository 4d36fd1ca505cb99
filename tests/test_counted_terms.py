"""Terms and features counted text by text, against the expressions over columns, and with ids that come again."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import encoding, retrieval
from passagework.sources.knowledge_base import KnowledgeBase

TEXTS = ["The cat and THE dog 12ab34", None, "", "état ＡＢ１ ﬁne Ⅷ İstanbul Kelvin", "机器x学习 the 机", "豈 豈 x", "a\x1cb c \x85d", "x", "no no no no", "straße mit 12 äpfeln, 3 ölen"]


def test_counts_are_those_of_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in df.select("text", T.index_tokens(F.col("text")).alias("t"), T.char_ngrams(F.col("text")).alias("g")).collect():
        low = T.folded(r["text"] or "")
        assert T.term_counts(r["text"] or "", low) == (Counter(r["t"]), len(r["t"])) and T.ngram_counts(low) == Counter(r["g"])
    # a character beyond the first plane is one, not two
    assert T.ngram_counts("ab😀cd") == Counter(["ab😀", "b😀c", "😀cd"])


def test_search_keeps_a_row_for_each_chunk(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, None), (1, "red red dog"), (None, "cat"), (None, "cat cow"), (3, "blue cow")], "chunk_id long, text string")
    asked = spark.createDataFrame([("q", "a red cat or the cow?")], "query_id string, question string")
    _, post = retrieval.query_postings(asked, docs)
    held = {r["chunk_id"]: (r["dl"], dict(zip(r["terms"], r["tfs"]))) for r in post.collect()}
    assert post.count() == 4 and {c: {t: n for t, n in x[1].items() if t != retrieval.WHOLE} for c, x in held.items()} == {1: {"red": 3, "cat": 1}, 2: {}, None: {"cat": 2, "cow": 1}, 3: {"cow": 1}}
    assert {c: x[0] for c, x in held.items()} == {1: 3, 2: 0, None: 2, 3: 2} and all(retrieval.WHOLE in x[1] for x in held.values())
    found = lambda: sorted(tuple(r) for r in retrieval.bm25_search(asked, docs, 3).select("rank", "chunk_id", "score").collect())
    few = found()
    before, retrieval.QUERY_ROWS = retrieval.QUERY_ROWS, 2
    try:
        many = found()
    finally:
        retrieval.QUERY_ROWS = before
    assert few == many and len(many) == 3


def test_anchors_among_few_and_many_items(spark):
    docs = spark.createDataFrame([(k, f"\n x{k} one\ttwo three four five six seven tail") for k in range(3)] + [(9, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one\ttwo three four five six seven"), (8, "x2 one"), (9, "two three four five six eight nine")], "item_id long, item string")
    want = [(0, 7), (1, 7), (2, 7), (2, 8)]
    assert sorted((r["doc_id"], r["item_id"]) for r in retrieval.containing(docs, items).collect()) == want
    before, retrieval.QUERY_ROWS = retrieval.QUERY_ROWS, 1
    try:
        assert sorted((r["doc_id"], r["item_id"]) for r in retrieval.containing(docs, items).collect()) == want
    finally:
        retrieval.QUERY_ROWS = before


def test_hashed_features_are_not_moved(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(8, "😀 no more"), (None, "cat")]
    df = spark.createDataFrame(rows, "k long, text string")
    for ngrams, n in ((True, 3), (True, 2), (False, 3)):
        want = defaultdict(lambda: defaultdict(int))
        for k, t in rows:
            low = T.folded(t or "")
            for f, times in (T.term_counts(t or "", low)[0] + (T.ngram_counts(low, n) if ngrams else Counter())).items():
                b = encoding.hashed_feature(f, 64)
                want[k][~b if b < 0 else b] += -times if b < 0 else times
        want = {k: {b: w / math.sqrt(sum(x * x for x in v.values())) for b, w in v.items() if w} for k, v in want.items() if k is not None and any(v.values())}
        got = defaultdict(dict)
        for r in encoding.hash_vectors(df, "k", 64, ngrams, n).collect():
            got[r["k"]][r["bucket"]] = r["value"]
        assert got == want
    assert "Exchange" not in encoding.hash_vectors(df.where("k < 5"), "k", 64)._jdf.queryExecution().executedPlan().toString()
    features = spark.createDataFrame([(f"f{i}",) for i in range(40)], "f string").select("f", encoding.bucket(F.col("f"), 300).alias("b"), encoding.sign(F.col("f")).alias("s"))
    assert all(encoding.hashed_feature(r["f"], 300) == (r["b"] if r["s"] > 0 else ~r["b"]) for r in features.collect())


def test_more_characters_than_are_numbered():
    texts = ["".join(chr(0x4E00 + (i * 7 + j * 3) % 900) for j in range(40)) + "ab" for i in range(30)] + ["", "a", "ab", "äbc"]
    made = encoding.Hashing(32, True, 3)
    got = [made.sums(texts[lo : lo + 9]) for lo in range(0, len(texts), 9)]
    for t, row in zip(texts, (r for part in got for r in part)):
        want = [0] * 32
        for f, n in (T.term_counts(t, t)[0] + T.ngram_counts(t)).items():
            b = encoding.hashed_feature(f, 32)
            want[~b if b < 0 else b] += -n if b < 0 else n
        assert row.tolist() == want


def test_saving_splits_texts_once(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, {"kind": "fixed", "size": 100, "overlap": 0}, {"dimension": 16, "use_ngrams": False})
    kb.add(spark.createDataFrame([("a", "red cat red"), ("b", "cat"), ("c", "the")], "doc_id string, text string"))
    want = sorted(tuple(r) for r in kb.postings.collect()), tuple(kb.corpus_stats.first()), sorted(tuple(r) for r in kb.term_stats.collect())
    assert [r["vector"] == [0.0] * 16 for r in kb.chunks.orderBy("doc_id").collect()] == [False, False, True]
    calls = []
    split = retrieval.chunk_terms
    monkeypatch.setattr(retrieval, "chunk_terms", lambda *a, **k: calls.append(1) or split(*a, **k))
    kb.save(str(tmp_path / "kb"))
    assert len(calls) == 1
    held = KnowledgeBase.load(spark, str(tmp_path / "kb"))
    assert (sorted(tuple(r) for r in held.postings.select("term", "chunk_id", "tf", "dl").collect()), tuple(held.corpus_stats.first()), sorted(tuple(r) for r in held.term_stats.select("term", "df").collect())) == want
