"""An inverted-file index for approximate vector search: cells, short codes of what is left, exact scores for the best.

Cells are the nearest of some centroids; a vector's residual, what its centroid leaves,
is coded in a byte for each few dimensions. Centroids and code books are fitted on a
sample of bounded size, every vector is in a cell and has a code. A search visits the
cells nearest to each query, as many as its width says, scores their codes, and scores
the best of all visited cells again, exactly. The width is a matter of each search:
nothing is built again when it changes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.retrieval import DIGITS, SPACES, if_small, matches, tiled_top_k, top_k

#: Most rows, and bytes of vectors, of the sample that centroids and code books are fitted on.
FIT_ROWS, FIT_BYTES = 1 << 16, 64 << 20
#: Cells: one for each CELL_ROOT-th part of the root of the number of vectors, within these bounds.
CELL_ROOT, LEAST_CELLS, MOST_CELLS = 2, 4, 4096
#: Dimensions for each byte of a code, and the entries of its book.
CODED, BOOK = 4, 256
#: Vectors, and queries, that are multiplied at once; larger cells and query sets are cut into such blocks.
TILE_ROWS, TILE_QUERIES = 8192, 1024
ROUNDS = 12


def kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows; a centre that nothing is nearest to moves to the row farthest from its own."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        far = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)[None, :]
        nearest = far.argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, rows)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        lost = np.flatnonzero(~filled)[: len(rows)]
        centres[lost] = rows[np.argsort(-far.min(1), kind="stable")[: len(lost)]]
    return centres


@dataclass
class Cells:
    """The fitted part: centroids, code books by group of dimensions, and the space they are for."""

    space: str
    centroids: np.ndarray
    books: np.ndarray

    def _prepared(self, v: np.ndarray) -> np.ndarray:
        """Unit length where only directions count; dimensions filled up to whole groups."""
        if self.space == "cosine":
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return np.pad(v, ((0, 0), (0, self.books.shape[0] * CODED - v.shape[1])))

    def order(self, v: np.ndarray) -> np.ndarray:
        """All cells of each vector, the nearest first."""
        v = self._prepared(v)
        return np.argsort((self.centroids**2).sum(1)[None, :] - 2 * v @ self.centroids.T, axis=1, kind="stable")

    def coded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of each vector."""
        cell = self.order(v)[:, 0]
        rest = (self._prepared(v) - self.centroids[cell]).reshape(len(v), -1, CODED)
        code = [((book**2).sum(1)[None, :] - 2 * rest[:, g] @ book.T).argmin(1) for g, book in enumerate(self.books)]
        return cell, np.stack(code, 1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([self.books[g][codes[:, g]] for g in range(len(self.books))], 1)
        return self.centroids[cell] + rest

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        return SPACES[self.space](self._prepared(q), self.decoded(cell, codes)).T

    def to_row(self) -> tuple:
        return (json.dumps({"space": self.space, "centroids": self.centroids.shape, "books": self.books.shape}), self.centroids.astype("<f8").tobytes(), self.books.astype("<f8").tobytes())

    @classmethod
    def from_row(cls, row) -> Cells:
        told = json.loads(row[0])
        centroids, books = (np.frombuffer(bytes(b), "<f8").reshape(told[name]) for b, name in ((row[1], "centroids"), (row[2], "books")))
        return cls(told["space"], centroids, books)


def fit(vectors: DataFrame, space: str = "cosine", cells: int | None = None, seed: int = 7, fit_rows: int = FIT_ROWS) -> Cells:
    """Centroids and books from the vectors whose ids have the least hashes, fit_rows at most and no more than FIT_BYTES."""
    count, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    room = max(1, min(fit_rows, FIT_BYTES // (8 * width)))
    # a little more than is needed passes by its hash, so that only these are sorted
    share = min(1.0, 1.2 * room / max(count, 1) + 0.001)
    hashed = vectors.select("chunk_id", "vector", F.xxhash64(F.lit(seed), "chunk_id").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = hashed.orderBy("h", "chunk_id").limit(room).select("vector").toArrow().column("vector").combine_chunks()
    v = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if len(sample) else np.zeros((1, width))
    model = Cells(space, np.zeros((0, 0)), np.zeros((-(-width // CODED), 0, CODED)))
    v = model._prepared(v)
    k = cells or max(LEAST_CELLS, min(MOST_CELLS, int(count**0.5 / CELL_ROOT)))
    model.centroids = kmeans(v, k, seed)
    far = (model.centroids**2).sum(1)[None, :] - 2 * v @ model.centroids.T
    rest = (v - model.centroids[far.argmin(1)]).reshape(len(v), -1, CODED)
    model.books = np.stack([kmeans(rest[:, g], BOOK, seed + g) for g in range(rest.shape[1])])
    return model


def with_cells(vectors: DataFrame, model: Cells) -> DataFrame:
    """vectors with the columns cell and code; all other columns stay."""
    held = vectors.sparkSession.sparkContext.broadcast(model)  # FIT_BYTES bounds it

    @F.pandas_udf("cell int, code binary")
    def coded(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
        cell, code = held.value.coded(np.stack(v.to_numpy()).astype(np.float64))
        return pd.DataFrame({"cell": cell.astype("int32"), "code": [c.tobytes() for c in code]})

    named = vectors.withColumn("_coded", coded(F.col("vector")))
    return named.select(*[f"`{c}`" for c in vectors.columns if c not in ("cell", "code")], "_coded.cell", "_coded.code")


def _near(model, width: int, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            cells = model.value.order(v)[:, :width]
            take = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(id_type), batch.column(1).take(take), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    return run


def _visited(model, width: int):
    """Whether a row's cell is one that a query visits."""

    def among(_, q: np.ndarray, cells: pa.Array) -> np.ndarray:
        visits = np.zeros((len(q), len(model.value.centroids)), bool)
        np.put_along_axis(visits, model.value.order(q)[:, :width], True, axis=1)
        return visits[:, cells.to_numpy()]

    return among


def _best(model, rescored: int, query_type: pa.DataType, id_type: pa.DataType):
    """A block of a cell against a block of queries: each query's best rows by their codes."""
    schema = pa.schema([("query_id", query_type), ("chunk_id", id_type), ("near", pa.float64())])

    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return schema.empty_table()
        q = asked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
        near = np.round(model.value.approximate(q, key[0].as_py(), codes), DIGITS)
        k = min(rescored, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        asked_by = pa.array(np.repeat(np.arange(len(q)), k))
        return pa.Table.from_arrays([asked.column("query_id").combine_chunks().take(asked_by).cast(query_type), rows.column("chunk_id").combine_chunks().take(pa.array(at.ravel())).cast(id_type), pa.array(np.take_along_axis(near, at, 1).ravel())], schema=schema)

    return run


_KINDS = {"long": (pa.int64(), "long"), "integer": (pa.int64(), "long")}


def _exact(space: str) -> Column:
    """The score of (asked, vector) as column arithmetic."""
    both = lambda f: F.aggregate(F.zip_with("asked", "vector", lambda a, b: f(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    if space == "l2":
        return 1 / (1 + both(lambda a, b: (a - b) * (a - b)))
    dot = both(lambda a, b: a * b)
    return dot if space == "ip" else dot / F.greatest(norm(F.col("asked")) * norm(F.col("vector")), F.lit(1e-12))


def search(queries: DataFrame, index: DataFrame, model: Cells, k: int, width: int, rescored: int | str | None = None, where: dict | None = None) -> DataFrame:
    """The best k of each query(query_id, vector) among index(chunk_id, vector, cell, code, ...): query_id, chunk_id, score, rank, source.

    Each query visits its `width` nearest cells, and its `rescored` best rows by their
    codes (ten for each of k unless told) get exact scores. Cells that no query visits
    aren't read where the index is stored by cell. Large cells and query sets are cut
    into blocks, so no task holds more than a block of each. Filters come first. Ties go
    by chunk_id. With rescored "all" every row of the visited cells gets its exact score
    where it lies, and no code is looked at; with a width of all cells that is exact.
    """
    spark, rescored = index.sparkSession, rescored or 10 * k
    width = max(1, min(width, len(model.centroids)))
    held = spark.sparkContext.broadcast(model)
    if rescored == "all":
        rows = index.where(matches(where, index.columns)).select("chunk_id", "vector", "cell")
        if width == len(model.centroids):
            return tiled_top_k(queries, rows, k, model.space)
        return tiled_top_k(queries.select("query_id", "vector", F.lit(0)), rows, k, model.space, among=_visited(held, width))
    kinds = [_KINDS.get(t.dataType.typeName(), (pa.string(), "string")) for t in (queries.schema["query_id"], index.schema["chunk_id"])]
    near = queries.select("query_id", "vector").mapInArrow(_near(held, width, kinds[0][0]), f"query_id {kinds[0][1]}, vector array<{queries.schema['vector'].dataType.elementType.simpleString()}>, cell int")
    tiles = max(1, -(-queries.count() // TILE_QUERIES))
    visited = [r[0] for r in near.select("cell").distinct().collect()]  # no more than there are cells
    rows = index.where(F.col("cell").isin(visited)).where(matches(where, index.columns))
    # blocks of each cell, a row for each cell at most
    blocks = F.broadcast(rows.groupBy("cell").agg((F.floor((F.count("*") - 1) / TILE_ROWS) + 1).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    dealt = rows.select("chunk_id", "code", "cell").join(blocks, "cell").select("chunk_id", "code", "cell", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    asked = near.join(blocks, "cell").select("query_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int").alias("tile"))
    keys = ("cell", "block", "tile")
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_best(held, rescored, kinds[0][0], kinds[1][0]), f"query_id {kinds[0][1]}, chunk_id {kinds[1][1]}, near double")
    chosen = top_k(found, rescored, [F.desc("near"), F.asc("chunk_id")]).select("query_id", "chunk_id")
    vectors = rows.select(F.col("chunk_id"), "vector")
    met = vectors.join(if_small(chosen), "chunk_id").join(if_small(queries.select("query_id", F.col("vector").alias("asked"))), "query_id")
    hits = met.select("query_id", "chunk_id", F.round(_exact(model.space), DIGITS).alias("score"))
    return top_k(hits, k, [F.desc("score"), F.asc("chunk_id")]).withColumn("source", F.lit("vector"))


def save(index: DataFrame, model: Cells, path: str) -> None:
    """The rows in a folder for each cell, and the fitted part."""
    index.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index.sparkSession.createDataFrame([model.to_row()], "told string, centroids binary, books binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    return spark.read.parquet(f"{path}/rows"), Cells.from_row(spark.read.parquet(f"{path}/model").first())


def recall(found: DataFrame, truth: DataFrame, among: Sequence[str] = ("query_id", "chunk_id")) -> DataFrame:
    """One row (n, recall): the share of truth's rows that were found."""
    hit = truth.select(*among).join(found.select(*among).withColumn("hit", F.lit(1)), list(among), "left")
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
