"""Exact BM25 search that leaves out blocks of chunks which can't reach a query's best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.retrieval import DIGITS, bm25_weight, if_small, in_folders, kept_table, query_terms, top_k

#: Chunks of a block, about; classes of lengths for each doubling of the length.
BLOCK_CHUNKS, CLASSES = 32, 4
#: Sums of weights in another order may differ by less than this.
SLACK = 1e-8


def _length_class(dl: Column) -> Column:
    return F.floor(F.log2(F.greatest(dl, F.lit(1))) * CLASSES).cast("long")


def with_blocks(post: DataFrame) -> DataFrame:
    """post(term, chunk_id, tf, dl) with the block of each chunk.

    Chunks of a block have about the same length, so that their shortest one says much
    about all; within a class of lengths they are dealt by the hash of their id, some
    BLOCK_CHUNKS to a block. A chunk's tf sum up to its dl, so a class's chunks are
    counted without a distinct.
    """
    classes = post.groupBy(_length_class(F.col("dl")).alias("class")).agg(F.round(F.sum(F.col("tf") / F.col("dl")) / BLOCK_CHUNKS).cast("long").alias("blocks"))
    rows = post.withColumn("class", _length_class(F.col("dl"))).join(F.broadcast(classes), "class")  # CLASSES rows for each power of two
    number = F.pmod(F.xxhash64("chunk_id"), F.greatest("blocks", F.lit(1)))
    return rows.withColumn("block", F.shiftleft("class", 40) + number).drop("class", "blocks")


def bounds(post: DataFrame) -> DataFrame:
    """(term, block, tf, dl): the most occurrences and the least length; whatever k1, b and the corpus are, no chunk of the block weighs more."""
    return post.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))


def search(queries: DataFrame, post: DataFrame, bound: DataFrame, terms: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, folders: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, scored): the rows of bm25_top_k, and the blocks (query_id, block) whose postings were looked at.

    post and bound are with_blocks() and bounds(). A block's bound for a query is the sum
    of its terms' bounds. The k blocks with the highest bounds are scored first; the
    k-th score that this gives a query is what other blocks' bounds have to reach to be
    scored at all, and a query with fewer than k hits by then has all its blocks scored.
    Postings may be filtered: the bounds hold for any part of a block. Two passes
    over the questions' postings and one over their bounds; no side is broadcast but
    after a check of its size.
    """
    wanted = if_small(query_terms(queries))
    post, bound, terms = (in_folders(t, wanted, folders) for t in (post, bound, terms))
    known = if_small(terms.join(if_small(wanted.select("term").distinct()), "term", "left_semi"))
    weighed = if_small(wanted.join(known, "term").crossJoin(F.broadcast(corpus)))  # one row
    weight = bm25_weight(F.col("n"), F.col("avgdl"), F.col("df"), F.col("tf"), F.col("dl"), k1, b)
    tops = kept_table(bound.join(weighed, "term").groupBy("query_id", "block").agg(F.sum(weight).alias("most")))

    def scored(blocks: DataFrame) -> DataFrame:
        asked = if_small(blocks.select("query_id", "block").join(weighed, "query_id"))
        return post.join(asked, ["term", "block"]).select("query_id", "chunk_id", weight.alias("w")).groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), DIGITS).alias("score"))

    order = [F.desc("score"), F.asc("chunk_id")]
    early = kept_table(top_k(tops, k, [F.desc("most"), F.asc("block")]).select("query_id", "block"))
    found = kept_table(top_k(scored(early), k, order))
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    reach = tops.join(if_small(least), "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK))
    late = kept_table(reach.join(if_small(early), ["query_id", "block"], "left_anti").select("query_id", "block"))
    hits = top_k(found.drop("rank").unionByName(scored(late)), k, order).withColumn("source", F.lit("bm25"))
    return hits, early.unionByName(late)
