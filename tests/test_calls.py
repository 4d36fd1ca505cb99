"""The durable table of model calls: no answered prompt is asked again, whatever ends a run."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from passagework.operators import calls, generation
from passagework.plans.pipeline import Pipeline
from passagework.plans import config as C
from passagework.plans.registry import registry


class Written:
    """Says a prompt in capitals and notes each call in a file; dies with its worker on one prompt if a flag file is there, fails on another."""

    def __init__(self, folder):
        self.log, self.deadly = f"{folder}/calls", f"{folder}/deadly"

    def ask(self, text, system=None):
        if text == "p77" and os.path.exists(self.deadly):
            os._exit(1)
        with open(self.log, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError("no")
        return f"{system or ''}{text.upper()}"

    def calls(self):
        with open(self.log) as f:
            return f.read().split()


def prompts(spark, n=200):
    return spark.range(n).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit(1).alias("answer_of"))


def test_a_job_that_dies_keeps_its_finished_answers(spark, tmp_path):
    llm = Written(tmp_path)
    kept = calls.Kept(llm, "m", str(tmp_path / "table"), concurrent=2, task_prompts=8)
    open(llm.deadly, "w").close()
    with pytest.raises(Exception):
        calls.said(prompts(spark), "prompt", kept)
    first, held = llm.calls(), calls.read_calls(spark, kept.path)
    stored = held.count() if held is not None else 0
    os.remove(llm.deadly)
    got = {r["id"]: r["answer"] for r in calls.said(prompts(spark), "prompt", kept).collect()}
    assert got == {k: f"P{k}" for k in range(200)}
    again = llm.calls()[len(first):]
    assert len(again) == len(set(again)) == 200 - stored
    n = len(llm.calls())
    assert calls.said(prompts(spark), "prompt", kept).where("answer is null").count() == 0 and len(llm.calls()) == n


def test_equal_prompts_nulls_errors_and_names(spark, tmp_path):
    llm = Written(tmp_path)
    kept = calls.Kept(llm, "m", str(tmp_path / "table"))
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bad"), (5, "")], "k int, prompt string")
    said = lambda k, system=None: {r["k"]: (r["answer"], r["error"]) for r in calls.said(rows, "prompt", k, system).collect()}
    want = {1: ("A", None), 2: ("A", None), 3: (None, None), 4: (None, "no"), 5: ("", None)}
    assert said(kept) == want and llm.calls().count("a") == 1
    assert said(kept) == want and llm.calls().count("a") == 1 and llm.calls().count("bad") == 2  # a failure is no answer
    assert said(kept, "s:")[1] == ("s:A", None) and said(kept.using(llm, "other")) == want and llm.calls().count("a") == 3
    assert said(llm) == want  # without a table
    empty = calls.said(rows.limit(0), "prompt", calls.Kept(llm, "m", str(tmp_path / "none")))
    assert empty.columns == ["k", "prompt", "answer", "error"] and empty.count() == 0


def test_rate_and_open_calls():
    now, slept = [0.0], []
    rate = calls.Rate(4, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        rate.wait()
    assert slept == [0.0, 0.25, 0.5]
    open_calls, most, lock = [0], [0], threading.Barrier(3, timeout=10)

    class Together:
        def ask(self, text, system=None):
            open_calls[0] += 1
            most[0] = max(most[0], open_calls[0])
            lock.wait()  # passes only if three calls are open at once
            open_calls[0] -= 1
            return text

    asking = calls._asking(Together(), None, 3, None)
    assert next(asking(iter([(None, ["a", "b", "c"])]))) == (None, [("a", None), ("b", None), ("c", None)]) and most[0] == 3


def test_rerankers_and_pipeline_use_the_table(spark, tmp_path):
    q = spark.createDataFrame([("q1", "which"), ("q2", "what")], "query_id string, question string")
    hits = spark.createDataFrame([(q, n + 1, f"c{n}", f"text {n}", 1.0 - n / 10, "bm25") for q in ("q1", "q2") for n in range(3)], "query_id string, rank int, chunk_id string, text string, score double, source string")
    log = str(tmp_path / "posts")

    def post(url, body):
        with open(log, "a") as f:
            f.write("x")
        if body["query"] == "what":
            raise OSError("down")
        return {"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]}

    client = generation.HttpReranker("m", "http://x", post=post, max_retries=1, sleep=lambda s: None)
    rows = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    want = [("q1", 1, "c2", "text 2", 0.9, "rerank:api"), ("q1", 2, "c0", "text 0", 0.1, "rerank:api"), ("q2", 1, "c0", "text 0", 1.0, "bm25"), ("q2", 2, "c1", "text 1", 0.9, "bm25")]
    kept = registry.build("llm", {"type": "kept", "inner": {"type": "echo"}, "path": str(tmp_path / "table")})
    assert rows(generation.rerank_api(q, hits, 2, client)) == want
    os.remove(log)
    assert rows(generation.rerank_api(q, hits, 2, client, kept)) == want and rows(generation.rerank_api(q, hits, 2, client, kept)) == want
    with open(log) as f:
        assert len(f.read()) == 3  # the answered query once, the failing one each time

    class Scores:
        def ask(self, text, system=None):
            return 'so: [{"id": 1, "score": 9}, {"id": 2, "score": 3}]' if "which" in text else "none"

    got = rows(generation.rerank_llm(q, hits, 3, Scores()))
    assert [(r[0], r[2], r[4], r[5]) for r in got] == [("q1", "c1", 9.0, "rerank:llm"), ("q1", "c2", 3.0, "rerank:llm"), ("q1", "c0", 0.0, "rerank:llm"), ("q2", "c0", 1.0, "bm25"), ("q2", "c1", 0.9, "bm25"), ("q2", "c2", 0.8, "bm25")]
    made = Pipeline(spark, C.merge(C.load(), {"llm": {"type": "kept", "inner": {"type": "echo"}, "path": str(tmp_path / "two")}, "generator": {"type": "stuff"}}))
    made.index(spark.createDataFrame([("d1", "cats sleep all day"), ("d2", "dogs run")], "doc_id string, text string"))
    ask = spark.createDataFrame([("a", "where do cats sleep")], "query_id string, question string")
    first = made.answer(ask)[0].first()["text"]
    assert "cats" in first and made.answer(ask)[0].first()["text"] == first and calls.read_calls(spark, str(tmp_path / "two")).count() == 1
