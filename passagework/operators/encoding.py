"""Encoders: text to vectors."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import folded, ngram_counts, squeezed, term_counts
from passagework.operators.retrieval import if_small, kept_table


def bucket(feature: Column, dimension: int) -> Column:
    """md5 of the feature as an integer, modulo dimension: Horner's rule over its four 32-bit words."""
    total = F.lit(0).cast("long")
    for k in range(4):
        word = F.conv(F.substring(F.md5(feature), 8 * k + 1, 8), 16, 10).cast("long")
        total = (total * F.lit(4294967296 % dimension) + word) % dimension
    return total.cast("int")


def sign(feature: Column) -> Column:
    """+1 or -1 by bit 8 of md5."""
    return F.when(F.conv(F.substring(F.md5(feature), 30, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


#: Features whose hashes a task remembers.
KNOWN = 1 << 18


def hashed_feature(feature: str, dimension: int) -> int:
    """The feature's bucket, md5 as an integer modulo dimension; inverted (~) where bit 8 of md5 says -1."""
    number = int.from_bytes(hashlib.md5(feature.encode()).digest())
    return number % dimension if number >> 8 & 1 else ~(number % dimension)


def hash_vectors(rows: DataFrame, key: str, dimension: int = 512, use_ngrams: bool = True, ngram: int = 3, unique: bool = False) -> DataFrame:
    """Sparse unit vectors: (key, bucket, value); empty texts have no rows, nor have keys that are null.

    Features are counted text by text and each different one is hashed once in a task, as
    long as it remembers it. Texts of one key are one, which needs a look at all keys
    unless they are unique: only the sums of keys that come again are moved.
    """
    rows = rows.where(F.col(key).isNotNull()).select(key, "text")
    again = None
    if not unique:
        again = kept_table(rows.groupBy(key).count().where("count > 1").select(key))
        again = None if again.isEmpty() else if_small(again)
    alone = _feature_sums(rows if again is None else rows.join(again, key, "left_anti"), key, dimension, use_ngrams, ngram)
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x * x))
    unit = alone.withColumn("norm", norm(F.col("ws"))).select(key, "norm", F.inline(F.arrays_zip("buckets", "ws")))
    out = unit.select(key, F.col("buckets").alias("bucket"), (F.col("ws") / F.col("norm")).alias("value"))
    if again is None:
        return out
    parts = _feature_sums(rows.join(again, key, "left_semi"), key, dimension, use_ngrams, ngram).select(key, F.inline(F.arrays_zip("buckets", "ws")))
    added = parts.groupBy(key, F.col("buckets").alias("bucket")).agg(F.sum("ws").alias("w")).where("w <> 0")
    norms = added.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return out.unionByName(added.join(norms, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("value")))


class Hashing:
    """Sums of the signs of texts' features by bucket; what it has hashed before it remembers, so each task has its own."""

    def __init__(self, dimension: int, use_ngrams: bool, ngram: int):
        self.dimension, self.use_ngrams, self.ngram, self.known = dimension, use_ngrams, ngram, {}
        #: Numbers of characters, 0 for those beyond the first 255, and the hashes of windows of three numbered ones, 0 where not known yet.
        self.numbers, self.numbered, self.windows = np.zeros(0x110000, np.uint8), 0, None

    def hash(self, feature: str) -> int:
        b = self.known.get(feature)
        if b is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            b = self.known[feature] = hashed_feature(feature, self.dimension)
        return b

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, a column for each bucket."""
        lowered = [folded(t or "") for t in texts]
        at, hashes, times = [], [], []
        for row, (text, low) in enumerate(zip(texts, lowered)):
            counts, _ = term_counts(text or "", low)
            if self.use_ngrams and self.ngram != 3:
                counts.update(ngram_counts(low, self.ngram))
            at += [row] * len(counts)
            hashes += map(self.hash, counts.keys())
            times += counts.values()
        parts = [(np.array(at, np.int64), np.array(hashes, np.int64), np.array(times, np.float64))]
        if self.use_ngrams and self.ngram == 3:
            parts.append(self._trigrams([squeezed(low) for low in lowered]))
        at, hashes, times = (np.concatenate(p) for p in zip(*parts))
        bucket = np.where(hashes < 0, ~hashes, hashes)
        held = np.bincount(at * self.dimension + bucket, np.where(hashes < 0, -times, times), len(texts) * self.dimension)
        return held.reshape(len(texts), self.dimension)

    def _trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, times) of each window of three characters; shorter texts are one window."""
        short = [(row, self.hash(t)) for row, t in enumerate(texts) if 0 < len(t) < 3]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.flatnonzero(row[:-2] == row[2:]) if len(points) > 2 else np.zeros(0, np.int64)
        if self.numbered < 255:
            for c in np.unique(points[self.numbers[points] == 0])[: 255 - self.numbered]:
                self.numbered += 1
                self.numbers[c] = self.numbered
        if self.windows is None:
            self.windows = np.zeros(1 << 24, np.int32)
        n = self.numbers[points].astype(np.int32)
        code = n[starts] << 16 | n[starts + 1] << 8 | n[starts + 2]
        code[(n[starts] == 0) | (n[starts + 1] == 0) | (n[starts + 2] == 0)] = 0
        found = self.windows[code]
        joined, missing = "".join(texts), np.flatnonzero(found == 0)
        if len(missing):
            _, first = np.unique(code[missing], return_index=True)
            for i in missing[first].tolist():
                if code[i]:  # a hash of 0 or more is kept plus one, so that 0 says that it isn't known
                    h = hashed_feature(joined[starts[i] : starts[i] + 3], self.dimension)
                    self.windows[code[i]] = h + 1 if h >= 0 else h
            found = self.windows[code]
        found = np.where(found > 0, found - 1, found).astype(np.int64)
        for i in np.flatnonzero(code == 0).tolist():
            found[i] = self.hash(joined[starts[i] : starts[i] + 3])
        more = np.array(short, np.int64).reshape(-1, 2)
        at, found = np.r_[row[starts], more[:, 0]], np.r_[found, more[:, 1]]
        return at, found, np.ones(len(at))


#: Sums and characters, about, that a task holds at a time.
SUMS, CHARACTERS = 1 << 20, 1 << 20


def _slices(lengths: list[int], dimension: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded number and length."""
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and ((i - lo + 1) * dimension > SUMS or held + n > CHARACTERS):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def _feature_sums(rows: DataFrame, key: str, dimension: int, use_ngrams: bool, ngram: int) -> DataFrame:
    """(key, buckets, ws) for each of rows(key, text): sums of its features' signs that aren't 0."""

    def run(batches):
        hashing = Hashing(dimension, use_ngrams, ngram)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices([len(t or "") for t in texts], dimension):
                sums = hashing.sums(texts[lo:hi])
                row, bucket = np.nonzero(sums)
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                columns = [pa.array(bucket, pa.int32()), pa.array(sums[row, bucket].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.ListArray.from_arrays(ends, c) for c in columns)], [key, "buckets", "ws"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, buckets array<int>, ws array<long>")


def hashed_vector(text: Column, dimension: int = 512, use_ngrams: bool = True, ngram: int = 3) -> Column:
    """The same vector, dense, of zeros for an empty text."""

    @F.pandas_udf("array<float>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashing = Hashing(dimension, use_ngrams, ngram)
        for s in texts:
            made, held = [], s.tolist()
            for lo, hi in _slices([len(t or "") for t in held], dimension):
                sums = hashing.sums(held[lo:hi])
                made += list((sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)).astype(np.float32))
            yield pd.Series(made, index=s.index, dtype=object)

    return vector(text)


def densify(sparse: DataFrame, key: str, dimension: int) -> DataFrame:
    """(key, vector)."""
    held = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(dimension - 1))
    return held.select(key, F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vector"))


def unit(vector: Column) -> Column:
    """The vector divided by its norm, unless that is tiny."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def http_detail(error: urllib.error.HTTPError, most: int = 500) -> str:
    """What a service says about a refused request: the message in its JSON body, else the body, else the status line."""
    try:
        body = error.read().decode("utf-8", "replace")
    except Exception:
        body = ""
    try:
        said = json.loads(body)
        said = said.get("error", said)
        body = str(said.get("message") or said) if isinstance(said, dict) else str(said)
    except (ValueError, AttributeError):
        pass
    return (body or str(error.reason))[:most]


class HttpEncoder:
    """An embeddings endpoint of the common JSON form: {model, input} to {data: [{index, embedding}]}.

    A batch that is refused as too large (400, 413) is halved and the smaller size
    remembered; 401, 403 and 404 fail at once; other errors are tried again, waiting
    longer each time. post can be given in tests.
    """

    def __init__(self, model: str, base_url: str, api_key: str = "", dimension: int = 1536, batch_size: int | None = None, timeout: float = 60, max_retries: int = 3, post=None, sleep=time.sleep):
        self.model, self.url, self.api_key, self.dimension = model, base_url.rstrip("/") + "/embeddings", api_key, dimension
        self.batch_size, self.timeout, self.max_retries = batch_size or int(os.environ.get("EMBED_BATCH_SIZE", 32)), timeout, max_retries
        self._post, self._sleep = post or self._http, sleep

    def _http(self, url: str, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def _one(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.max_retries):
            try:
                data = sorted(self._post(self.url, {"model": self.model, "input": texts})["data"], key=lambda d: d["index"])
                if len(data) != len(texts):
                    raise ValueError(f"{len(data)} embeddings for {len(texts)} texts")
                return [d["embedding"] for d in data]
            except urllib.error.HTTPError as e:
                if e.code in (400, 413) and len(texts) > 1:
                    half = len(texts) // 2
                    self.batch_size = min(self.batch_size, half)
                    return self._one(texts[:half]) + self._one(texts[half:])
                if e.code in (401, 403, 404) or attempt == self.max_retries - 1:
                    raise RuntimeError(f"the encoder's endpoint answers {e.code}: {http_detail(e)}") from e
            except (OSError, ValueError, KeyError):
                if attempt == self.max_retries - 1:
                    raise
            self._sleep(2**attempt)
        raise RuntimeError("no attempt was allowed")

    def encode(self, texts: list[str], is_query: bool = False) -> list[list[float]]:
        out: list[list[float]] = []
        texts = [t if t and t.strip() else " " for t in texts]
        while len(out) < len(texts):
            out += self._one(texts[len(out) : len(out) + self.batch_size])
        v = np.array(out, np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True) if len(out) else np.ones((0, 1))
        return np.where(norm > 1e-12, v / np.maximum(norm, 1e-12), v).tolist() if len(out) else []


class SentenceEncoder:
    """A local sentence-transformers model; loaded at first use on each worker."""

    def __init__(self, model_name: str, query_prefix: str = "", doc_prefix: str = "", batch_size: int = 32, device: str | None = None):
        self.model_name, self.query_prefix, self.doc_prefix, self.batch_size, self.device, self._model = model_name, query_prefix, doc_prefix, batch_size, device, None

    def encode(self, texts: list[str], is_query: bool = False) -> list[list[float]]:
        if self._model is None:
            from sentence_transformers import SentenceTransformer  # optional

            self._model = SentenceTransformer(self.model_name, device=self.device)
        prefix = self.query_prefix if is_query else self.doc_prefix
        return self._model.encode([prefix + t for t in texts], batch_size=self.batch_size, normalize_embeddings=True).tolist()


def encode_with(rows: DataFrame, key: str, encoder, is_query: bool = False) -> DataFrame:
    """(key, vector) by an encoder object, which is sent to workers; each batch is encoded as a whole."""

    @F.pandas_udf("array<float>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(encoder.encode([t or "" for t in s], is_query), index=s.index)

    return rows.select(key, encoded("text").alias("vector"))


def cache_key(text: Column, config: str, is_query: bool = False) -> Column:
    """The key of a cached vector: encoder's configuration, side and text."""
    return F.md5(F.concat(F.lit(config), F.lit("|1|" if is_query else "|0|"), F.coalesce(text, F.lit(""))))


def encode_cached(rows: DataFrame, key: str, encoder, cache: DataFrame | None, config: str, is_query: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, vector) and the grown cache (cache_key, vector)."""
    fresh = missing_vectors(rows, encoder, cache, config, is_query)
    grown = fresh if cache is None else cache.unionByName(fresh)
    return from_cache(rows, key, grown, config, is_query), grown


def missing_vectors(rows: DataFrame, encoder, cache: DataFrame | None, config: str, is_query: bool = False) -> DataFrame:
    """(cache_key, vector) of the texts that the cache lacks, each distinct one encoded once."""
    wanted = rows.select(cache_key(F.col("text"), config, is_query).alias("cache_key"), "text").dropDuplicates(["cache_key"])
    return encode_with(wanted if cache is None else wanted.join(cache, "cache_key", "left_anti"), "cache_key", encoder, is_query)


def from_cache(rows: DataFrame, key: str, cache: DataFrame, config: str, is_query: bool = False) -> DataFrame:
    """(key, vector) of texts that are all in the cache."""
    return rows.withColumn("cache_key", cache_key(F.col("text"), config, is_query)).join(cache, "cache_key").select(key, "vector")


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A cache that earlier sessions left at path, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("cache_key string, vector array<float>").parquet(path).dropDuplicates(["cache_key"])
