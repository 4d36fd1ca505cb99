"""Stored indexes: versions, folders of postings; metrics that fail; configurations; Markdown sections."""

import json
import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunking, retrieval
from passagework.plans import config as C
from passagework.plans.evaluate import default_metrics, evaluate
from passagework.plans.pipeline import Pipeline
from passagework.sources.knowledge_base import KnowledgeBase, drop_versions, versions

TEXTS = [(f"d{k}", " ".join(f"w{(k * j) % 50}" for j in range(1, 30)) + (" rare" if k == 7 else "")) for k in range(40)]


def base(spark, texts=TEXTS):
    return KnowledgeBase(spark, {"kind": "fixed", "size": 1 << 20, "overlap": 0}, {"dimension": 8}).add(spark.createDataFrame(texts, "doc_id string, text string"))


def search(kb, questions, spark):
    q = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(questions)], "query_id string, question string")
    return retrieval.bm25_top_k(q, kb.postings, kb.term_stats, kb.corpus_stats, 3, folders=kb.folders)


def test_only_folders_of_the_questions_are_read(spark, tmp_path):
    kb = base(spark)
    whole = {tuple(r) for r in search(kb, ["rare w3", "w9 w10", "unknown"], spark).collect()}
    kb.save(f"{tmp_path}/kb")
    kb = KnowledgeBase.load(spark, f"{tmp_path}/kb")
    assert {tuple(r) for r in search(kb, ["rare w3", "w9 w10", "unknown"], spark).collect()} == whole
    hits = search(kb, ["rare"], spark)
    assert hits.count() == 1
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [folder") + plan.count("PartitionFilters: [isnotnull(folder") >= 1
    wanted = spark.createDataFrame([("rare",)], "term string")
    files = lambda rows: rows.select(F.input_file_name()).distinct().count()
    assert files(retrieval.in_folders(kb.postings, wanted, kb.folders)) == 1 < files(kb.postings)
    # postings meet the questions' terms by broadcast: the only exchanges are of scored rows
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/kb"
    base(spark).save(path)
    assert versions(spark, path) == [0]
    more = KnowledgeBase.load(spark, path).add(spark.createDataFrame([("new", "entirely fresh words")], "doc_id string, text string"))

    def dies(*_):
        raise OSError("the disk went away")

    with monkeypatch.context() as m:
        m.setattr(retrieval, "term_stats", dies)
        with pytest.raises(OSError):
            more.save(path)
    assert KnowledgeBase.load(spark, path).chunks.count() == len(TEXTS) and versions(spark, path) == [0]
    again = KnowledgeBase.load(spark, path).add(spark.createDataFrame([("new", "entirely fresh words")], "doc_id string, text string"))
    again.save(path)
    assert versions(spark, path) == [0, 1] and KnowledgeBase.load(spark, path).chunks.count() == len(TEXTS) + 1
    drop_versions(spark, path)
    assert versions(spark, path) == [1] and search(KnowledgeBase.load(spark, path), ["fresh"], spark).count() == 1


class Samples:
    name = "tiny"

    def __init__(self, spark):
        self.spark = spark

    def corpus(self):
        return self.spark.createDataFrame(TEXTS[:9], "doc_id string, text string")

    def samples(self):
        return self.spark.createDataFrame([("s", "rare w7", ["w7"], ["d7"])], "sample_id string, question string, answers array<string>, gold_doc_ids array<string>")


def test_a_failing_metric_is_told_and_the_others_count(spark):
    def broken(samples, hits, answers):
        return samples.select("sample_id", F.lit("broken").alias("metric"), F.raise_error(F.lit("no such luck")).cast("double").alias("value"))

    config = C.load(retriever={"type": "bm25"}, generator={"type": "extractive"})
    report = evaluate(Pipeline(spark, config), Samples(spark), 3, metric_set={"broken": broken, "recall": default_metrics(3)["recall"]})
    assert report.summary["recall@3"] == 1.0 and len(report.errors) == 1 and report.errors[0].startswith("broken: ")
    assert set(default_metrics(3, generate=False)) == {"recall", "precision", "hit_rate", "mrr", "map", "ndcg", "context_recall"}


def test_configurations_merge_by_path():
    def plain(old, new):
        if not (isinstance(old, dict) and isinstance(new, dict)) or ("type" in old and "type" in new and old["type"] != new["type"]):
            return new
        return {k: plain(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in {**old, **new}}

    r = random.Random(6)

    def made(depth):
        names = r.sample(["type", "a", "b", "c"], r.randint(0, 3))
        return {n: r.choice(["x", "y"]) if n == "type" else made(depth - 1) if depth and r.random() < 0.6 else r.choice([1, None, [1, {"q": 2}], [], "t"]) for n in names}

    for _ in range(3000):
        old, new = made(3), made(3)
        assert C.merge(old, new) == plain(old, new), (old, new)
    nested = {"a": [{"b": "${X}"}, ["${Y:-2.5}", {}], []], "c": {}, "d": "n${X}"}
    assert C.expand(nested, {"X": "7"}) == {"a": [{"b": 7}, [2.5, {}], []], "c": {}, "d": "n7"}


def test_markdown_sections(spark):
    text = "lost\n# A b \nx y\n\n### deep\nz\n## C\n\n#\n\nfoo\nlast"
    rows = spark.createDataFrame([(text,), ("no heading",), ("",), ("# only",)], "text string")
    got = [[(s["path"], s["body"]) for s in r[0]] for r in rows.select(chunking.sections(F.col("text"))).collect()]
    assert got == [[("A b", "x y"), ("A b > deep", "z"), ("foo", "last")], [], [], []]
    docs = rows.withColumn("doc_id", F.length("text"))
    cut = chunking.chunk(docs, "markdown", 100, 10).orderBy("doc_id", "position").collect()
    assert [r["text"] for r in cut] == ["no heading", "[A b]\nx y", "[A b > deep]\nz", "[foo]\nlast"]
    assert json.dumps([r["position"] for r in cut]) == "[0, 0, 1, 2]"
