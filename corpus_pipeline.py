"""A training-corpus pipeline: each stage's table is written and read again before the next.

Every stage takes any rows of the documents' columns: nulls in each of them, empty and
very long texts, repeated rows and ids, no rows at all; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from passagework.llm.blobs import cut
from passagework.llm.queries import MIN_SITES, MIX_PERCENT, WEIGHTS, domain, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a text without 20 words, null and empty ones included, goes. Repeated rows are judged alike."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that has nothing else and is on several sites as a whole stays as it is, since its copies are the next stage's task. A null site counts for no line; null texts stay null; all rows stay."""
    cleaned = line_dedup.clean_lines(docs.select(*COLUMNS), MIN_SITES, keep_whole=True)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def row_key() -> Column:
    """Names a row by its id and text: nulls and repeated ids with other texts have keys of their own, only equal rows share one."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row with the smallest id, nulls last; of equal rows the least one. Rows without words stay."""
    docs = docs.select(*COLUMNS).withColumn("_key", row_key())
    found = cut(ngram_join.similar_groups(docs.select("_key", "text"), "_key")).where("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id")
    ids = docs.select("_key", "doc_id").distinct()
    stays = found.distinct().join(ids, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")).alias("first")).select("first._key")
    stays = cut(stays)
    goes = found.select("_key").distinct().join(stays, "_key", "left_anti")
    kept = docs.join(goes, "_key", "left_anti")
    equal = cut(found.join(stays, "_key", "left_semi").groupBy("_key").count().where("count > 1").select("_key"))
    if equal.limit(1).count():
        one = kept.join(equal, "_key", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
        kept = kept.join(equal, "_key", "left_anti").select(*COLUMNS).unionByName(one.select("doc_id", "text", "r.*"))
    return kept.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; one that has any goes as a whole, and no other row of its id."""
    items = table(spark, sf_dir, "benchmark")
    docs = docs.select(*COLUMNS).withColumn("_key", row_key())
    bad = decontaminate.find_benchmark(docs.select(F.col("_key").alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(bad, "_key", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selection for the target weights, with the number of copies of each document; rows without words have nothing to add and stay out, null languages and sources are groups of their own."""
    return mixing.mix(docs.select(*COLUMNS), domain(), None, WEIGHTS, keep=True, percent=MIX_PERCENT)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mixture)]

#: The near-duplicate and mixing stages together are no practical SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; all but the last are written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
