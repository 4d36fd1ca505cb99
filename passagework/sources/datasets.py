"""Evaluation datasets: corpus() gives documents(doc_id, text, title, doc_ord), samples() gives samples(sample_id, question, answers, gold_doc_ids, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators.retrieval import if_small, kept_table
from passagework.sources.json_elements import elements
from passagework.sources.loaders import numbered_lines


def _first(rows: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    return rows.orderBy(order).limit(limit) if limit else rows


def _strings(line: Column, field: str) -> Column:
    """A field that is a JSON list, or a scalar, as a list of strings; its JSON type decides, not how a string begins."""
    m = F.from_json(line, "map<string,string>")
    value, parsed = F.try_element_at(m, F.lit(field)), F.try_parse_json(line)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$['" + field.replace("'", "") + "']", "variant"))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(kind.startswith("ARRAY"), F.from_json(value, "array<string>")).otherwise(F.array(value))


class JsonlDataset:
    """qa.jsonl with questions, answers and gold ids, and corpus.jsonl; field names are parameters; a limit holds for the samples."""

    def __init__(self, spark: SparkSession, qa_path: str, corpus_path: str | None = None, question_field: str = "question", answer_field: str = "answers", gold_field: str = "gold_doc_ids", id_field: str = "id", limit: int | None = None, name: str = "jsonl"):
        self.spark, self.qa_path, self.corpus_path, self.limit, self.name = spark, qa_path, corpus_path, limit, name
        self.fields = question_field, answer_field, gold_field, id_field

    def _maps(self, path: str) -> DataFrame:
        return numbered_lines(self.spark, path).where(F.trim("value") != "").withColumn("m", F.from_json("value", "map<string,string>"))

    def corpus(self) -> DataFrame:
        if self.corpus_path is None:
            return self.spark.createDataFrame([], "doc_id string, text string, title string, doc_ord long")
        get = lambda name: F.try_element_at("m", F.lit(name))
        return self._maps(self.corpus_path).select(F.coalesce(get("id"), get("doc_id"), get("_id")).alias("doc_id"), F.coalesce(get("text"), F.lit("")).alias("text"), get("title").alias("title"), "doc_ord")

    def samples(self) -> DataFrame:
        question, answer, gold, id_ = self.fields
        get = lambda name: F.try_element_at("m", F.lit(name))
        rows = self._maps(self.qa_path).select(F.coalesce(get(id_), F.col("doc_ord").cast("string")).alias("sample_id"), get(question).alias("question"), _strings(F.col("value"), answer).alias("answers"), _strings(F.col("value"), gold).alias("gold_doc_ids"), F.map_filter("m", lambda k, v: ~k.isin(question, answer)).alias("metadata"), F.col("doc_ord").alias("ord"))
        return _first(rows, self.limit)


class HotpotDataset:
    """One JSON array of multi-hop questions; paragraphs are documents, the first of each title counts; a limit holds for both tables."""

    SCHEMA = "_id string, question string, answer string, type string, level string, context string, supporting_facts string"

    def __init__(self, spark: SparkSession, path: str, limit: int | None = None):
        self.spark, self.path, self.limit, self.name = spark, path, limit, "hotpotqa"

    def _items(self) -> DataFrame:
        rows, _ = elements(self.spark, self.path, 1)
        items = rows.select("ord", F.from_json("text", self.SCHEMA).alias("i")).select("i.*", "ord")
        return _first(items, self.limit)

    def corpus(self) -> DataFrame:
        pairs = self._items().select("ord", F.posexplode(F.from_json("context", "array<array<string>>")).alias("pos", "p"))
        rows = pairs.select(F.element_at("p", 1).alias("title"), F.array_join(F.from_json(F.element_at("p", 2), "array<string>"), "").alias("text"), "ord", "pos")
        first = rows.groupBy("title").agg(F.min(F.struct("ord", "pos", "text")).alias("f"))
        return first.select(F.col("title").alias("doc_id"), F.col("f.text").alias("text"), "title", (F.shiftleft(F.col("f.ord").cast("long"), 24) + F.col("f.pos")).alias("doc_ord"))

    def samples(self) -> DataFrame:
        gold = F.array_sort(F.array_distinct(F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda x: x[0])))
        return self._items().select(F.col("_id").alias("sample_id"), "question", F.array(F.coalesce("answer", F.lit(""))).alias("answers"), gold.alias("gold_doc_ids"), "type", "level", "ord")


class SquadDataset:
    """data -> paragraphs -> qas; a paragraph's id, or article#paragraph, made unique with the article's number; a limit counts questions."""

    ARTICLE = "id string, title string"
    PARAGRAPH = "id string, context string, qas array<struct<id:string,question:string,answers:array<struct<text:string>>>>"

    def __init__(self, spark: SparkSession, path: str, limit: int | None = None):
        self.spark, self.path, self.limit, self.name = spark, path, limit, "squad"

    def _paragraphs(self) -> DataFrame:
        articles, paragraphs = elements(self.spark, self.path, 2, 4, kept_table)
        named = articles.select(F.col("ord").alias("a_idx"), F.from_json("text", self.ARTICLE).alias("a"), "first").select("a_idx", F.col("a.id").alias("a_id"), F.col("a.title").alias("title"), "first")
        read = paragraphs.select(F.col("ord").alias("a_idx"), "inner", F.from_json("text", self.PARAGRAPH).alias("p"))
        rows = read.join(if_small(named), "a_idx").withColumn("p_idx", F.col("inner") - F.col("first"))
        own = F.coalesce("p.id", F.concat(F.coalesce("a_id", F.concat(F.lit("a"), F.col("a_idx"))), F.lit("#"), F.col("p_idx")))
        again = F.row_number().over(Window.partitionBy("own").orderBy("a_idx", "p_idx")) > 1
        named = rows.withColumn("own", own).withColumn("doc_id", F.when(again, F.concat("own", F.lit("#"), "a_idx", F.lit("_"), "p_idx")).otherwise(F.col("own")))
        return named.select("a_idx", "p_idx", "doc_id", "title", "p")

    def corpus(self) -> DataFrame:
        return self._paragraphs().select("doc_id", F.col("p.context").alias("text"), "title", (F.shiftleft(F.col("a_idx").cast("long"), 32) + F.col("p_idx")).alias("doc_ord"))

    def samples(self) -> DataFrame:
        qas = self._paragraphs().select("a_idx", "p_idx", "doc_id", F.posexplode("p.qas").alias("q_idx", "q"))
        texts = F.filter(F.transform("q.answers", lambda a: a["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
        rows = qas.select(F.col("q.id").alias("sample_id"), F.col("q.question").alias("question"), F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(""))).alias("answers"), F.array("doc_id").alias("gold_doc_ids"), F.struct("a_idx", "p_idx", "q_idx").alias("ord"))
        return _first(rows, self.limit)


class BeirDataset:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv; the limit counts qrels groups before they meet queries."""

    def __init__(self, spark: SparkSession, root: str, split: str = "test", limit: int | None = None):
        self.spark, self.root, self.split, self.limit, self.name = spark, root.rstrip("/"), split, limit, "beir"

    def corpus(self) -> DataFrame:
        rows = numbered_lines(self.spark, f"{self.root}/corpus.jsonl").select("doc_ord", F.from_json("value", "_id string, title string, text string").alias("j")).select("doc_ord", "j.*").where("_id is not null")
        text = F.regexp_replace(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), r"(?U)^\s+|\s+$", "")
        return rows.select(F.col("_id").alias("doc_id"), text.alias("text"), "title", "doc_ord")

    def samples(self) -> DataFrame:
        queries = self.spark.read.schema("_id string, text string").option("lineSep", "\n").json(f"{self.root}/queries.jsonl").where("_id is not null")
        lines = numbered_lines(self.spark, f"{self.root}/qrels/{self.split}.tsv").where("doc_ord > 0").withColumn("p", F.split("value", "\t"))
        rel = lines.where((F.size("p") >= 3) & (F.expr("try_cast(p[2] as double)") > 0)).select(F.col("p")[0].alias("qid"), F.col("p")[1].alias("did"), "doc_ord")
        groups = rel.groupBy("qid").agg(F.min("doc_ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "did"))), lambda s: s["did"]).alias("gold_doc_ids"))
        kept = _first(groups, self.limit)
        return kept.join(queries, kept.qid == queries["_id"]).select(F.col("qid").alias("sample_id"), F.col("text").alias("question"), F.array().cast("array<string>").alias("answers"), "gold_doc_ids", "ord")


DATASETS = {"jsonl": JsonlDataset, "hotpotqa": HotpotDataset, "squad_style": SquadDataset, "beir_style": BeirDataset}


def convert(dataset, out: str) -> None:
    """Any dataset as corpus.jsonl(id, title, text) and qa.jsonl(id, question, answers, gold_doc_ids) folders."""
    dataset.corpus().select(F.col("doc_id").alias("id"), "title", "text").write.mode("overwrite").json(f"{out}/corpus.jsonl")
    dataset.samples().select(F.col("sample_id").alias("id"), "question", "answers", "gold_doc_ids").write.mode("overwrite").json(f"{out}/qa.jsonl")


def _listed(spark: SparkSession, path: str):
    """(name, is a folder) of what lies in a folder, by the session's file systems; none for a file."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at))


def scan(spark: SparkSession, root: str, depth: int = 3) -> dict[str, dict[str, object]]:
    """Every dataset below a folder, by its path: files that probe() knows, and folders of the three-part form."""
    names = dict(_listed(spark, root))
    if {"corpus.jsonl", "queries.jsonl", "qrels"} <= set(names):
        return {root: probe(spark, root)}
    found = {}
    for name, folder in names.items():
        path = f"{root.rstrip('/')}/{name}"
        if name.endswith((".json", ".jsonl")):
            found[path] = probe(spark, path)
        elif folder and depth > 1:
            found |= scan(spark, path, depth - 1)
    return found


def probe(spark: SparkSession, path: str) -> dict[str, object]:
    """What a file holds, by its first character and keys: the kind of dataset, its fields, and a count; a folder of the three-part form has its splits."""
    names = dict(_listed(spark, path))
    if {"corpus.jsonl", "queries.jsonl", "qrels"} <= set(names):
        splits = [n.removesuffix(".tsv") for n, _ in _listed(spark, f"{path.rstrip('/')}/qrels") if n.endswith(".tsv")]
        corpus = spark.read.option("lineSep", "\n").json(f"{path.rstrip('/')}/corpus.jsonl")
        judged = {s: max(0, spark.read.text(f"{path.rstrip('/')}/qrels/{s}.tsv").count() - 1) for s in splits}  # without the header
        return {"kind": "beir_style", "rows": corpus.count(), "fields": corpus.columns, "splits": judged}
    head = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    line = (head[0] if head else "").lstrip()
    if line.startswith("["):
        items = HotpotDataset(spark, path)._items()
        return {"kind": "hotpotqa", "rows": items.count()}
    if line.startswith("{") and spark.read.option("multiLine", "true").json(path).columns == ["data"] or '"data"' in line[:40]:
        return {"kind": "squad_style", "rows": SquadDataset(spark, path).samples().count()}
    rows = spark.read.option("lineSep", "\n").json(path)
    return {"kind": "jsonl", "rows": rows.count(), "fields": rows.columns}
