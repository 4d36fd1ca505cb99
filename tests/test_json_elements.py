"""Objects of one JSON value, cut by many tasks, against a reader of the whole."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.sources import datasets, json_elements
from passagework.sources.json_elements import elements


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "😀", " ", ",", "\n", "\\\\}", '\\"']) for _ in range(r.randint(0, 30)))


def article(r, k):
    paragraphs = [{"context": text(r), "qas": [{"id": f"q{k}-{p}", "question": text(r), "answers": [{"text": text(r)}] if p % 2 else []}]} | ({"id": f"own{k % 3}"} if p == 1 else {}) for p in range(r.randint(0, 6))]
    fields = [("title", text(r)), ("paragraphs", paragraphs), ("note", [1, [2], text(r)])]
    r.shuffle(fields)  # what stands before and after the inner objects
    return dict(fields) | ({"id": f"a{k}"} if k % 4 else {})


def test_elements_equal_a_whole_read(spark, tmp_path, small_blocks):
    r = random.Random(2)
    for indent in (None, 2):
        data = {"version": text(r), "data": [article(r, k) for k in range(60)], "end": {"x": "}"}}
        path = tmp_path / f"{indent}.json"
        path.write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20  # many tasks read it
        outer, inner = elements(spark, str(path), 2, 4)
        got = {x["ord"]: (json.loads(x["text"]), x["first"]) for x in outer.collect()}
        assert sorted(got) == list(range(60))
        count = 0
        for k, a in enumerate(data["data"]):
            assert got[k] == (a | {"paragraphs": []}, count)
            count += len(a["paragraphs"])
        want = [p for a in data["data"] for p in a["paragraphs"]]
        assert [json.loads(x["text"]) for x in inner.orderBy("inner").collect()] == want
        flat, none = elements(spark, str(path), 2)
        assert none is None and [json.loads(x["text"]) for x in flat.orderBy("ord").collect()] == data["data"]


def test_files_of_a_folder_follow_each_other(spark, tmp_path, small_blocks):
    r = random.Random(3)
    items = [{"_id": f"i{k}", "question": text(r), "answer": text(r), "context": [[f"t{k % 9}", [text(r), text(r)]]], "supporting_facts": [[f"t{k % 9}", 0]]} for k in range(90)]
    folder = tmp_path / "hotpot.json"
    folder.mkdir()
    parts = ["[null"] + [", " + json.dumps(x) for x in items] + ["]"]
    for k in range(4):
        (folder / f"part-{k}.txt").write_text("\n".join(parts[k * 25 : (k + 1) * 25]) + "\n", encoding="utf-8")
    data = datasets.HotpotDataset(spark, str(folder))
    samples = data.samples().orderBy("ord").collect()
    assert [(x["sample_id"], x["question"], x["answers"], x["gold_doc_ids"]) for x in samples] == [(i["_id"], i["question"], [i["answer"]], [i["supporting_facts"][0][0]]) for i in items]
    first = {}
    for i in items:
        first.setdefault(i["context"][0][0], "".join(i["context"][0][1]))
    assert {x["doc_id"]: x["text"] for x in data.corpus().collect()} == first
    assert [x["sample_id"] for x in datasets.HotpotDataset(spark, str(folder), limit=3).samples().orderBy("ord").collect()] == ["i0", "i1", "i2"]


def test_empty_values(spark, tmp_path):
    for k, content in enumerate(("[]", "", "{}", "[null, 1]", '{"data": []}', '{"data": [{"title": "t", "paragraphs": []}]}')):
        path = tmp_path / f"{k}.json"
        path.write_text(content)
        outer, inner = elements(spark, str(path), 2, 4)
        assert inner.count() == 0 and outer.count() == (k == 5)
        assert datasets.SquadDataset(spark, str(path)).samples().count() == 0
    assert outer.select(F.get_json_object("text", "$.title")).first()[0] == "t"


def test_blocks_are_looked_at_in_slices():
    values = [f'{{"a": "é{k}' for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 1500 + ["g"] * 1500), pa.array([0] * 3000), pa.array([9] * 3000), pa.array(values)], names=["file", "start", "file_size", "value"])
    before, json_elements.SLICE = json_elements.SLICE, 1000
    try:
        runs = list(json_elements._runs([batch]))
    finally:
        json_elements.SLICE = before
    assert max(len(data.decode()) for *_, data in runs) <= 1000
    for file, part in (("f", values[:1500]), ("g", values[1500:])):
        assert b"".join(data for f, _, _, data in runs if f == file).decode() == "".join(v + "}" for v in part)


def test_objects_over_the_border_of_files(spark, tmp_path, small_blocks):
    folder = tmp_path / "squad.json"
    folder.mkdir()
    parts = ['{"data": [null']
    for k in range(3):
        parts += [f', {{"title": "in {k}", "paragraphs": [null', *(f', {{"context": "c{k}-{p}\nx", "qas": []}}'.replace("\n", "\\n") for p in range(40)), "]}"]
    parts.append("]}")
    for k in range(10):
        (folder / f"part-{k}.txt").write_text("\n".join(parts[k * 13 : (k + 1) * 13]) + "\n", encoding="utf-8")
    rows = datasets.SquadDataset(spark, str(folder)).corpus().orderBy("doc_ord").collect()
    assert [(x["doc_id"], x["title"], x["text"]) for x in rows] == [(f"a{k}#{p}", f"in {k}", f"c{k}-{p}\nx") for k in range(3) for p in range(40)]
