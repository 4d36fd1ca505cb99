"""Incremental indexing of a folder of documents with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import chunking, retrieval

DOCUMENT_SCHEMA = "doc_id string, text string"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, chunker: dict | None = None, schema: str = DOCUMENT_SCHEMA):
    """A query that appends the chunks and postings of new files to tables under target; each batch is one folder, so a batch that runs again replaces itself.

    Document frequencies and the mean length change with every batch: read() computes
    them from the tables, which is one aggregation over postings.
    """
    options = {"kind": "recursive", "size": 400, "overlap": 80, **(chunker or {})}

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk(batch, **options).dropDuplicates(["chunk_id"]).persist()
        try:
            chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
            retrieval.postings(chunks).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        finally:
            chunks.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """chunks, postings, term_stats and corpus_stats; of a chunk that came twice the first batch counts."""
    chunks = spark.read.option("basePath", f"{target}/chunks").parquet(f"{target}/chunks")
    first = chunks.groupBy("chunk_id").agg(F.min("batch").alias("batch"))
    chunks = chunks.join(first, ["chunk_id", "batch"], "left_semi")
    post = spark.read.option("basePath", f"{target}/postings").parquet(f"{target}/postings").join(first, ["chunk_id", "batch"], "left_semi").drop("batch")
    return {"chunks": chunks, "postings": post, "term_stats": retrieval.term_stats(post), "corpus_stats": retrieval.corpus_stats(chunks)}
