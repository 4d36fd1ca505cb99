"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.blobs import cut


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(a, b) links between long ids to (node, root): root is the smallest id reachable.

    Each round joins every node with the smallest of its neighbours (large star,
    then small star) and only keeps edges, so no neighbour list is ever collected
    and a hub's edges may be split over tasks. Nulls and self links are ignored;
    nodes without links have no row. It ends when a round changes nothing.
    """
    edges = links.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = cut(edges.distinct(), files), None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        linked = large.join(small, F.col("u") == F.col("w"))
        edges = cut(linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), files)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
