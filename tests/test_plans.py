"""Sources, configuration, pipelines, evaluation, streaming, and the driver's registry."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from passagework.plans import config as C
from passagework.plans.evaluate import ablate, evaluate
from passagework.plans.pipeline import Pipeline, ask
from passagework.plans.registry import Registry, registry
from passagework.sources import datasets, loaders
from passagework.sources.knowledge_base import KnowledgeBase, collection_name, persist_dir
from passagework.streaming import ingest

DOCS = [("d1", "The RRF constant is 60 by default.", {"title": "fusion"}), ("d2", "BM25 weighs rare terms more.", {}), ("d3", "Chunks overlap a little.", {})]


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_source(spark, tmp_path):
    p = lines(tmp_path / "c.jsonl", [{"id": "a", "text": "x y", "title": "T", "year": 2024}, {"text": "no id"}, {"id": "e", "text": ""}])
    rows = {r["doc_id"]: r for r in loaders.jsonl(spark, p).collect()}
    assert set(rows) == {"a", "1"} and rows["a"]["title"] == "T" and rows["a"]["metadata"]["year"] == "2024" and rows["1"]["title"] == "1"


def test_directory_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"# A\xff")
    (tmp_path / "sub" / "b c.txt").write_text("b")
    (tmp_path / "empty.txt").write_text(" \n")
    rows = {r["doc_id"]: (r["text"], r["title"]) for r in loaders.directory(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": ("# A", "a"), "sub/b c.txt": ("b", "b c")}


def test_datasets(spark, tmp_path):
    qa = lines(tmp_path / "qa.jsonl", [{"id": 1, "question": "q", "answers": "one", "gold_doc_ids": ["d1"]}, {"id": 2, "question": "r", "answers": ["a", "b"]}])
    s = {r["sample_id"]: r for r in datasets.JsonlDataset(spark, qa).samples().collect()}
    assert s["1"]["answers"] == ["one"] and s["2"]["answers"] == ["a", "b"] and s["2"]["gold_doc_ids"] == []
    hot = tmp_path / "h.json"
    hot.write_text(json.dumps([{"_id": "x", "question": "q", "answer": "a", "type": "t", "level": "l", "context": [["T", ["s1", "s2"]], ["U", ["u"]]], "supporting_facts": [["U", 0], ["T", 1], ["T", 0]]}, {"_id": "y", "question": "q", "answer": "b", "type": "t", "level": "l", "context": [["T", ["other"]]], "supporting_facts": []}]))
    h = datasets.HotpotDataset(spark, str(hot))
    assert {(r["doc_id"], r["text"]) for r in h.corpus().collect()} == {("T", "s1s2"), ("U", "u")}
    assert h.samples().where("sample_id = 'x'").first()["gold_doc_ids"] == ["T", "U"]
    squad = tmp_path / "s.json"
    para = {"context": "c", "qas": [{"id": "q", "question": "?", "answers": [{"text": ""}]}]}
    squad.write_text(json.dumps({"data": [{"title": "same", "id": "z", "paragraphs": [para]}, {"title": "same", "id": "z", "paragraphs": [para, para]}]}))
    d = datasets.SquadDataset(spark, str(squad), 2)
    ids = [r["doc_id"] for r in d.corpus().collect()]
    assert len(ids) == len(set(ids)) == 3 and d.samples().count() == 2 and d.samples().first()["answers"] == [""]
    root = tmp_path / "beir"
    (root / "qrels").mkdir(parents=True)
    lines(root / "corpus.jsonl", [{"_id": "1", "title": "T", "text": "x"}, {"_id": "2", "title": "", "text": "y"}])
    lines(root / "queries.jsonl", [{"_id": "q1", "text": "one"}])
    (root / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\t1\t1\nq1\t2\t1\nq1\t1\t2\nq1\t3\t0\nbad\n")
    b = datasets.BeirDataset(spark, str(root))
    assert {r["text"] for r in b.corpus().collect()} == {"T\nx", "y"}
    assert b.samples().first()["gold_doc_ids"] == ["2", "1"] and datasets.BeirDataset(spark, str(root), limit=1).samples().count() == 0
    assert datasets.probe(spark, qa)["kind"] == "jsonl" and datasets.probe(spark, str(hot)) == {"kind": "hotpotqa", "rows": 2}
    datasets.convert(b, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "qa.jsonl")).count() == 1


def test_config(tmp_path):
    env = {"M": "model", "D": "1024"}
    assert C.expand({"a": "${M}", "b": ["${D}"], "c": "${X:-1.5}", "d": "${X}"}, env) == {"a": "model", "b": [1024], "c": 1.5, "d": ""}
    assert C.merge({"r": {"type": "hybrid", "weights": [1]}}, {"r": {"type": "vector"}}) == {"r": {"type": "vector"}}
    assert C.merge({"r": {"type": "hybrid", "k": 1}}, {"r": {"k": 2}}) == {"r": {"type": "hybrid", "k": 2}}
    f = tmp_path / ".env"
    f.write_text("A=1\nB='two'\n")
    held = {"A": "kept"}
    assert C.load_dotenv(tmp_path / "no", f, env=held) and held == {"A": "kept", "B": "two"}
    assert C.load(tmp_path / "missing.json", pipeline={"top_k": 3})["pipeline"] == {"top_k": 3, "candidate_k": 20}
    assert persist_dir({"index": {"collection": "a"}}) != persist_dir({"index": {"collection": "b"}})
    assert collection_name("a/b") == "a_b" and collection_name("x") == "col_x"


def test_registry():
    r = Registry()
    r.register("n", "x", lambda a, llm=None: (a, llm))
    assert r.build("n", {"type": "x", "a": 1}, llm=2, other=3) == (1, 2) and r.build("n", {"type": "x", "a": 1, "llm": 9}, llm=2) == (1, 9)
    with pytest.raises(KeyError, match="there are: x"):
        r.build("n", "y")
    with pytest.raises(TypeError, match="can't be built"):
        r.build("n", {"type": "x", "b": 1})
    assert {"hybrid", "vector", "bm25", "transformed"} <= set(registry.options("retriever"))


class Small:
    name = "small"

    def __init__(self, spark):
        self.spark = spark

    def corpus(self):
        return loaders.memory(self.spark, DOCS)

    def samples(self):
        return self.spark.createDataFrame([("s1", "What is the RRF constant?", ["60"], ["d1"]), ("s2", "Which terms does BM25 weigh?", [""], [])], "sample_id string, question string, answers array<string>, gold_doc_ids array<string>")


def test_pipeline_and_knowledge_base(spark, tmp_path):
    p = Pipeline(spark, C.load()).index(loaders.memory(spark, DOCS))
    assert "60" in ask(p, "What is the RRF constant?").first()["text"]
    q = spark.createDataFrame([(1, "rare terms")], "query_id int, question string")
    assert p.contexts(q).orderBy("rank").first()["doc_id"] == "d2"
    folder = str(tmp_path / "kb")
    p.kb.save(folder)
    before = p.contexts(q).orderBy("rank").select("chunk_id", "score").collect()
    p.kb = KnowledgeBase.load(spark, folder)
    assert p.contexts(q).orderBy("rank").select("chunk_id", "score").collect() == before
    first = p.kb.chunks.first()["chunk_id"]
    assert p.kb.get(first).count() == 1 and p.kb.stats().first()["dimension"] == 512
    p.kb.add(loaders.memory(spark, DOCS[:1]))
    assert p.kb.stats().first()["chunks"] == 3


@pytest.mark.parametrize("patch", [{"retriever": {"type": "transformed", "inner": {"type": "bm25"}, "transformer": "multi_query"}}, {"retriever": {"type": "vector"}, "index": {"type": "lsh"}, "reranker": {"type": "llm"}}, {"generator": {"type": "stuff"}}, {"retriever": {"type": "vector", "where": {"doc_id": ["d1"]}}}])
def test_other_pipelines(spark, patch):
    p = Pipeline(spark, C.merge(C.DEFAULTS, patch)).index(loaders.memory(spark, DOCS))
    answers, hits = p.answer(spark.createDataFrame([(1, "RRF constant")], "query_id int, question string"))
    assert answers.count() == 1 and hits.orderBy("rank").first()["doc_id"] == "d1"


def test_evaluate_and_ablate(spark, tmp_path):
    report = evaluate(Pipeline(spark, C.load()), Small(spark))
    assert report.summary["recall@5"] == 1.0 and report.summary["answer_contains"] == 1.0 and "latency_retrieve" in report.summary
    assert report.scores.where("sample_id = 's2' and metric = 'recall@5'").count() == 0
    assert "| recall@5 | 1.0000 |" in report.to_markdown()
    report.save(str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["samples"] == 2
    table, skipped = ablate(spark, Small(spark), C.load(), "channel")
    assert not skipped and table.where("variant = 'vector'").agg(F.max(F.abs("delta"))).first()[0] == 0.0


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        lines(source / f"{k}.json", [{"doc_id": f"d{k}", "text": f"word{k} shared words"}, {"doc_id": "same", "text": "same text"}])
        query = ingest.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    t = ingest.read(spark, str(tmp_path / "out"))
    assert t["chunks"].count() == 3 and t["corpus_stats"].first()["n"] == 3 and t["term_stats"].where("term = 'shared'").first()["df"] == 2


def test_registered_queries():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and {"bm25_topk", "chunk_recursive", "eval_summary"} <= set(names)
