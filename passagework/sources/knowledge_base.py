"""A knowledge base: chunks with vectors and BM25 tables, kept as Parquet with a manifest."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import ann, block_max, chunking, encoding, retrieval

TABLES = ("chunks", "postings", "term_stats", "corpus_stats")


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def collection_name(name: str) -> str:
    """A safe name: other characters than letters, digits, . _ - become _, none of ._- at the ends, 3 to 512 long."""
    safe = re.sub(r"[^a-zA-Z0-9._-]", "_", name or "").strip("._-")
    return (safe if len(safe) >= 3 else f"col_{safe}")[:512]


def persist_dir(config: dict) -> str:
    """Each collection has a folder of its own."""
    index = config.get("index", {})
    return f"{index.get('path') or 'vector_store/default'}/_kb_{index.get('collection') or 'default'}"


class KnowledgeBase:
    """add() makes the tables from documents. Chunks that come again are taken from the later add; of equal ids within one add any row stays, as they have one text."""

    def __init__(self, spark: SparkSession, chunker: dict | None = None, encoder: dict | None = None):
        self.spark = spark
        self.chunker = {"kind": "recursive", "size": 400, "overlap": 80, **(chunker or {})}
        self.encoder = {"type": "hashing", "dimension": 512, "use_ngrams": True, "ngram": 3, **(encoder or {})}
        self.chunks: DataFrame | None = None
        self._cache: DataFrame | None = None
        self._cells: tuple | None = None
        #: In how many folders the stored postings lie.
        self.folders: int | None = None
        #: The stored postings' bounds by term and block.
        self.bounds: DataFrame | None = None
        #: What vectors must have as their length, if the encoder's configuration says it.
        self.width = (encoder or {}).get("dimension")

    def encoded(self, rows: DataFrame, key: str, is_query: bool = False) -> DataFrame:
        """(key, vector) by the encoder's object, through its cache if it has one; vectors of another length than configured, NaN or infinity fail."""
        e = self.encoder
        if "cache" not in e:
            made = encoding.encode_with(rows, key, e["object"], is_query)
        else:
            if self._cache is None and e["cache"]:
                self._cache = encoding.load_cache(self.spark, e["cache"])
            name = config_hash({k: v for k, v in e.items() if k not in ("object", "cache")})
            fresh = encoding.missing_vectors(rows, e["object"], self._cache, name, is_query)
            if e["cache"]:
                fresh.write.mode("append").parquet(e["cache"])
                self._cache = encoding.load_cache(self.spark, e["cache"])
            else:
                fresh = retrieval.kept_table(fresh)
                self._cache = fresh if self._cache is None else self._cache.unionByName(fresh)
            made = encoding.from_cache(rows, key, self._cache, name, is_query)
        return retrieval.check_vectors(made.withColumnRenamed(key, "chunk_id"), self.width).withColumnRenamed("chunk_id", key)

    def _encoded(self, chunks: DataFrame) -> DataFrame:
        e = self.encoder
        if e["type"] != "hashing":
            return chunks.join(self.encoded(chunks, "chunk_id"), "chunk_id", "left")
        return chunks.withColumn("vector", encoding.hashed_vector(F.col("text"), e["dimension"], e["use_ngrams"], e["ngram"]))  # no text is moved with its vector

    def add(self, docs: DataFrame) -> KnowledgeBase:
        cut = chunking.chunk(docs, **self.chunker)
        made = self._encoded(cut)
        if self.chunks is not None:
            # an upsert: chunks that come again are taken from the new ones; their ids need no vectors
            made = self.chunks.join(cut.select("chunk_id"), "chunk_id", "left_anti").unionByName(made, allowMissingColumns=True)
        self.chunks, self._cells = made.dropDuplicates(["chunk_id"]), None
        return self.index()

    def index(self) -> KnowledgeBase:
        self.postings, self.folders, self.bounds = retrieval.postings(self.chunks, unique=True), None, None
        self.term_stats = retrieval.term_stats(self.postings)
        self.corpus_stats = retrieval.corpus_stats(self.chunks)
        return self

    def cells(self, space: str = "cosine", cells: int | None = None) -> tuple:
        """(rows with cell and code, the fitted part) of the approximate index, built when it is first asked for."""
        if self._cells is None or self._cells[1].space != space or cells not in (None, len(self._cells[1].centroids)):
            model = ann.fit(self.chunks.select("chunk_id", "vector"), space, cells)
            self._cells = retrieval.kept_table(ann.with_cells(self.chunks, model)), model
        return self._cells

    def get(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def stats(self) -> DataFrame:
        """One row: documents, chunks, bm25_chunks (all are in the index), dimension."""
        return self.chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count("*").alias("bm25_chunks"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"))

    def save(self, path: str) -> None:
        """A new version: tables in a folder of their own, and a manifest that names it, written last.

        Until the manifest is complete load() gives the version before, so a write that
        ends half-way changes nothing. Postings and term statistics lie in folders by
        their terms' hashes, sorted by term, so a search reads the folders of its terms.
        Postings have the blocks of their chunks, with bounds for each term and block.
        Older versions stay until drop_versions().
        """
        held = versions(self.spark, path)
        version = f"{path}/versions/{uuid.uuid4().hex}"
        self.chunks.write.parquet(f"{version}/chunks")
        self.chunks = self.spark.read.parquet(f"{version}/chunks")
        terms = retrieval.kept_table(retrieval.chunk_terms(self.chunks))  # the texts are split once
        self.postings, corpus = retrieval.listed_terms(terms), terms.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
        count = self.chunks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6  # about a word each
        folders = max(retrieval.LEAST_FOLDERS, min(retrieval.MOST_FOLDERS, count // retrieval.POSTINGS_A_FOLDER))

        def foldered(table: DataFrame, name: str) -> None:
            placed = table.withColumn("folder", retrieval.folder_of(folders)).repartition("folder", F.pmod(F.hash("term"), F.lit(4)))
            placed.sortWithinPartitions("folder", "term", *(c for c in table.columns if c == "block")).write.partitionBy("folder").parquet(f"{version}/{name}")

        foldered(block_max.with_blocks(self.postings), "postings")
        self.postings, self.folders = self.spark.read.parquet(f"{version}/postings"), folders
        foldered(block_max.bounds(self.postings), "bounds")
        self.bounds = self.spark.read.parquet(f"{version}/bounds")
        foldered(retrieval.term_stats(self.postings), "term_stats")
        corpus.write.parquet(f"{version}/corpus_stats")
        self.term_stats, self.corpus_stats = (self.spark.read.parquet(f"{version}/{name}") for name in ("term_stats", "corpus_stats"))
        if self._cells is not None:
            ann.save(*self._cells, f"{version}/ann")
        manifest = {"chunker": self.chunker, "encoder": {k: v for k, v in self.encoder.items() if k not in ("object", "cache")}}
        manifest |= {"hash": config_hash(manifest), "ann": self._cells is not None, "version": version.rpartition("/")[2], "folders": folders, "blocks": True}
        number = 1 + max(held, default=-1)
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifests/{number}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder_object=None) -> KnowledgeBase:
        """The last version whose manifest is complete."""
        manifest = manifest_of(spark, path, max(versions(spark, path)))
        kb = cls(spark, manifest["chunker"], manifest["encoder"] | ({"object": encoder_object} if encoder_object else {}))
        version, kb.folders = f"{path}/versions/{manifest['version']}", manifest["folders"]
        for name in TABLES:
            setattr(kb, name, spark.read.parquet(f"{version}/{name}"))
        if manifest.get("blocks"):
            kb.bounds = spark.read.parquet(f"{version}/bounds")
        if manifest.get("ann"):
            kb._cells = ann.load(spark, f"{version}/ann")
        return kb


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests of a saved knowledge base."""
    fs, at = _file_system(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    named = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    return sorted(int(p.getName()) for p in named if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest_of(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/{number}").first()[0])


def drop_versions(spark: SparkSession, path: str) -> None:
    """Deletes all versions but the last complete one; tables that were loaded from them can't be read any more."""
    last = max(versions(spark, path))
    kept = {f"manifests/{last}", f"versions/{manifest_of(spark, path, last)['version']}"}
    for part in ("manifests", "versions"):
        fs, at = _file_system(spark, f"{path}/{part}")
        for s in fs.listStatus(at):
            if f"{part}/{s.getPath().getName()}" not in kept:
                fs.delete(s.getPath(), True)
