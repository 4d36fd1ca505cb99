"""Columns of numbers packed into one binary value for each hash range.

A shuffle of hundreds of millions of (hash, value) pairs costs far less as a
few thousand packed rows. Buckets are ranges of the hash's leading bits, their
number follows the input's size, so a bucket's size stays the same at any size.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for each bucket, and the fewest buckets.
BYTES_A_BUCKET, LEAST_BITS, MOST_BITS = 1 << 20, 9, 24
BLOB_SCHEMA = "bucket int, blob binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def bits_for(total: int) -> int:
    """Leading hash bits that name a bucket, for so many bytes of text."""
    return max(LEAST_BITS, min(MOST_BITS, int(total // BYTES_A_BUCKET).bit_length()))


def bucket_bits(docs: DataFrame, text_col: str) -> int:
    """The same for the size of these texts."""
    return bits_for(text_bytes(docs, text_col))


def pack(key: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob); key's next 32 bits and the columns are in the blob, entries sorted by key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    rest = ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cut.tolist(), len(key)]
    names, blobs = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        names.append(int(bucket[a]))
        blobs.append(b"".join([np.uint32(b - a).tobytes(), rest[a:b].tobytes(), *(c[a:b].tobytes() for c in columns)]))
    for a in range(0, len(names), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 1024], pa.int32()), pa.array(blobs[a : a + 1024], pa.binary())], schema=BLOB_ARROW)


def unpack(blobs: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """The 32-bit keys and columns of a bucket's blobs, concatenated."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(dtypes) + 1)]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for k, t in enumerate(["<u4", *dtypes]):
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, ["<u4", *dtypes])]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and everything runs on this machine, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows and bytes in an Arrow batch of queries run by tidy(): a row may hold two sets of thousands of tokens, and both sides hold a batch several times.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end, and send small batches to Python."""
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Bytes of the input for each file of a table that is much smaller than it, and the fewest files.
BYTES_A_FILE, LEAST_FILES = 32 << 20, 8


def files_for(total: int) -> int:
    """Files for tables of keys and links that follow from so many bytes of text: their number grows with the input, not with the shuffle's partitions."""
    return max(LEAST_FILES, total // BYTES_A_FILE)


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """df, written as a table in the shared checkpoint folder and read again: the lineage ends there. files: at most so many, for small tables."""
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
