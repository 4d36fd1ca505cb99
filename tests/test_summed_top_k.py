"""Scores summed where a chunk's postings lie, against joins and groups of all pairs."""

import random
import unicodedata

import pytest

from passagework.functions import text
from passagework.operators import retrieval


@pytest.mark.parametrize(("id_type", "most"), [("long", 1), ("string", 60), ("long", 1 << 21)])
def test_equal_to_joined_scores(spark, id_type, most):
    r = random.Random(most)
    words = [f"w{k}" for k in range(12)]
    made = [None if k == 0 else k if id_type == "long" else f"c{k}" for k in range(150)]
    post = []
    for c in made:
        held = {w: r.randint(1, 3) for w in r.sample(words, r.randint(1, 8))}
        post += [(w, c, tf, sum(held.values())) for w, tf in held.items()]
    asked = [(q, w) for q in range(9) for w in r.sample([*words, "none"], r.randint(1, 5))]
    post = spark.createDataFrame(post, f"term string, chunk_id {id_type}, tf long, dl long")
    wanted = spark.createDataFrame(asked, "query_id int, term string")
    stats = {t: n for t, n in post.groupBy("term").count().collect()}
    known = spark.createDataFrame(list(stats.items()), "term string, df long")
    corpus = spark.createDataFrame([(150, 9.5)], "n long, avgdl double")
    weights = retrieval._bm25_weights(wanted.collect(), stats, 150, 9.5, 1.5, 0.75)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # chunks go over the border of batches
    try:
        for k in (0, 1, 4, 200):
            want = retrieval._bm25_hits(post.join(wanted, "term").join(known, "term").crossJoin(corpus), k, 1.5, 0.75)
            got = retrieval.summed_top_k(retrieval.by_chunk(post), wanted.collect(), k, weights, wanted.schema["query_id"].dataType, most)
            key = lambda df: sorted((x["query_id"], x["rank"], x["chunk_id"] or "", x["score"]) for x in df.collect())
            assert key(got) == key(want) and (k == 0) == (not key(got))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_text_goes_with_anchors(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (None, "one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three four five six seven")], "item_id long, item string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in retrieval.containing(docs, items).collect()) == [(0, 7), (1, 7)]


def test_usual_characters_need_no_long_look(spark):
    for c in (*range(0x20, 0x300), 0x2019, 0x4E2D, 0xFF21, 0xFB01, 0x1F600):
        t = f"a{chr(c)}b"
        quick = spark._jvm.java.util.regex.Pattern.compile(text._UNUSUAL).matcher(t).find()
        assert quick or unicodedata.is_normalized("NFKC", t)
