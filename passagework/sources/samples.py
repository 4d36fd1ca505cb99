"""Small invented corpora with questions, for trying out pipelines: plain, with distractors, and with metadata, a table and tool labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.text import sentences, strip

DOCS = (
    ("harbour", "Harbour rules", "Boats longer than 12 metres moor at the north pier。The harbour master answers on channel 9。Night berths cost 15 coins。Fuel is sold until six in the evening。"),
    ("bakery", "The bakery", "The oven is lit at three in the morning。Rye bread rests for two days before it is baked。The shop opens at seven。On Sundays only rolls are sold。"),
    ("library", "Lending", "A card lets you borrow eight books。Loans last four weeks and can be renewed twice。Late books cost one coin a day。Maps stay in the reading room。"),
    ("观星", "观星指南", "木星在十一月整夜可见。双筒望远镜足以看到它的四颗卫星。山顶的天文台每周五开放。入场免费。"),
    ("茶园", "茶园笔记", "春茶在清明前采摘。采下的叶子要摊放六小时。炒锅的温度约为两百度。茶叶存放在陶罐里。"),
    ("tram", "Tram line 4", "Line 4 runs every ten minutes。The last tram leaves the square at half past eleven。Dogs ride for free。Tickets are sold at each stop。"),
)
QA = (
    ("s1", "Where do long boats moor?", ["north pier"], "harbour"),
    ("s2", "How long does rye bread rest?", ["two days"], "bakery"),
    ("s3", "How many books may one borrow?", ["eight"], "library"),
    ("s4", "木星什么时候整夜可见？", ["十一月"], "观星"),
    ("s5", "采下的叶子要摊放多久？", ["六小时"], "茶园"),
    ("s6", "When does the last tram leave?", ["half past eleven"], "tram"),
)
FILES = (
    ("tariff_new", "Tariff", "text", 2025, 90, "tariff", "A night in the harbour costs 15 coins. Children sleep for free."),
    ("tariff_old", "Tariff (withdrawn)", "text", 2018, 12, "tariff", "A night in the harbour costs 9 coins. Children pay half."),
    ("manual", "Manual of the crane", "text", 2023, 40, "manual", "The crane lifts four tons. It is greased every Monday."),
)
ORDERS = ((1, "north", "rope", 30, 4.5), (2, "south", "sail", 2, 250.0), (3, "north", "sail", 1, 250.0), (4, "west", "paint", 12, 11.0))
TOOL_QA = (
    ("t1", "What does a night cost now?", ["15"], ["tariff_new"], ["meta_filter"], {"tariff_new": 3.0, "tariff_old": 0.5}),
    ("t2", "How much does the crane lift?", ["four tons"], ["manual"], ["search"], {"manual": 1.0}),
    ("t3", "How many sails were ordered?", ["3"], [], ["sql_query"], {}),
)


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCS, "id string, title string, text string")


def distractors(docs: DataFrame, per_doc: int = 4, seed: int = 7) -> DataFrame:
    """per_doc texts for each document: its first half without the first sentence, which tends to hold the answer, and a sentence of another document, chosen by a hash."""
    listed = docs.withColumn("s", F.filter(F.transform(F.split("text", "。"), strip), lambda x: x != "")).withColumn("n", F.size("s"))
    numbered = listed.select(F.posexplode("s").alias("at", "lent"), F.col("id").alias("lender"))
    own = listed.select("id", "title", F.slice("s", 2, F.greatest(F.lit(0), F.floor(F.col("n") / 2).cast("int") - 1)).alias("kept"), F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("k"))
    # a document borrows from all others' sentences; the least hash of (number, sentence) is taken
    met = own.join(F.broadcast(numbered), F.col("id") != F.col("lender"))
    first = F.row_number().over(Window.partitionBy("id", "k").orderBy(F.xxhash64(F.lit(seed), "id", "k", "lender", "at"), "lender", "at"))
    chosen = met.withColumn("r", first).where("r = 1")
    text = F.concat(F.array_join(F.concat("kept", F.array("lent")), "。"), F.lit("。"))
    return chosen.select(F.concat("id", F.lit("_distract"), "k").alias("id"), F.concat("title", F.lit(" ("), F.col("k") + 1, F.lit(")")).alias("title"), text.alias("text"))


def write_samples(spark: SparkSession, folder: str, with_distractors: bool = False) -> None:
    """corpus.jsonl and qa.jsonl; with distractors corpus_hard.jsonl too, beside the plain one."""
    docs = documents(spark)
    docs.write.mode("overwrite").json(f"{folder}/corpus.jsonl")
    spark.createDataFrame([(i, q, a, [g]) for i, q, a, g in QA], "id string, question string, answers array<string>, gold_doc_ids array<string>").write.mode("overwrite").json(f"{folder}/qa.jsonl")
    if with_distractors:
        docs.unionByName(distractors(docs)).write.mode("overwrite").json(f"{folder}/corpus_hard.jsonl")


def write_tool_samples(spark: SparkSession, folder: str) -> None:
    """files.jsonl with numbers as metadata, the table orders, and questions labelled with the tools they ask for."""
    spark.createDataFrame(FILES, "id string, title string, file_type string, year int, popularity int, doc_kind string, text string").write.mode("overwrite").json(f"{folder}/files.jsonl")
    spark.createDataFrame(ORDERS, "id int, region string, product string, qty int, price double").write.mode("overwrite").parquet(f"{folder}/orders")
    schema = "id string, question string, answers array<string>, gold_doc_ids array<string>, expected_tools array<string>, gold_weights map<string,double>"
    spark.createDataFrame(TOOL_QA, schema).write.mode("overwrite").json(f"{folder}/tool_qa.jsonl")
