"""The objects inside one JSON value, read by many tasks.

The text is split at closing braces, which Spark's reader does in parallel and from any
file system. What a block of the file does to the reader's state (inside a string or
not, and how deep) is worked out for both states that it can begin in; these
summaries, a row for each block, are put together in the order of the file, and each
block is then cut into its objects, with the state that it truly begins in. An object
over the border of blocks comes in pieces, which are joined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a block that are looked at together, unless one fragment has more.
SLICE = 1 << 18
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = _CLOSE[[ord("}"), ord("]")]] = True


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(block, start, file_size, value): what lies before each closing brace, in the file's order within a block; a folder's files follow each other by name."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size"), "value")


def _runs(batches):
    """(file, start, file_size, bytes with their braces) of consecutive rows of a block, some SLICE characters at a time."""
    for batch in batches:
        files, starts, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        held, size, a = [], 0, 0
        for b in range(len(files)):
            value = values[b].as_py() + "}"
            if held and (size + len(value) > SLICE or (files[b], starts[b]) != (files[a], starts[a])):
                yield files[a], starts[a], batch.column(2)[a].as_py(), "".join(held).encode()
                held, size, a = [], 0, b
            held.append(value)
            size += len(value)
        if held:
            yield files[a], starts[a], batch.column(2)[a].as_py(), "".join(held).encode()


def _steps(data: bytes, quoted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bytes without escapes, each one's change of depth, and whether a string is open at the end."""
    plain = np.frombuffer(_ESCAPED.sub(b"\0\0", data), np.uint8)
    inside = (np.cumsum(plain == ord('"')) + quoted) & 1
    step = np.where(inside == 0, _OPEN[plain].astype(np.int64) - _CLOSE[plain], 0)
    return plain, step, int(inside[-1]) if len(inside) else quoted


_STATES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("file_size", pa.int64()), ("size", pa.int64()), ("end0", pa.int64()), ("deeper0", pa.int64()), ("end1", pa.int64()), ("deeper1", pa.int64())])


def _summary(batches):
    held = {}
    for file, start, file_size, data in _runs(batches):
        size, *states = held.get((file, start, file_size), (0, (0, 0), (1, 0)))
        for k, (quoted, deeper) in enumerate(states):
            _, step, end = _steps(data, quoted)
            states[k] = (end, deeper + int(step.sum()))
        held[file, start, file_size] = (size + len(data), *states)
    for key, (size, zero, one) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, size, *zero, *one), _STATES)], schema=_STATES)


def _begins(summaries: list) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(file, start) to the state (string open, depth) that the block begins in, and where its text ends if a brace follows that isn't the file's (else -1)."""
    quoted, depth, found = 0, 0, {}
    by_file = {}
    for r in sorted(summaries, key=lambda r: (r["file"], r["start"])):
        by_file.setdefault(r["file"], []).append(r)
    for file, blocks in by_file.items():
        for r in blocks:
            found[file, r["start"]] = (quoted, depth, -1)
            quoted, depth = (r["end1"], depth + r["deeper1"]) if quoted else (r["end0"], depth + r["deeper0"])
        if sum(r["size"] for r in blocks) > blocks[0]["file_size"]:  # no brace follows what is left at a file's end
            last = blocks[-1]
            found[file, last["start"]] = (*found[file, last["start"]][:2], last["size"] - 1)
            depth += not quoted
    return found


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outer", pa.int64()), ("inner", pa.int64()), ("nested", pa.bool_()), ("at", pa.int64()), ("whole", pa.bool_()), ("piece", pa.string())])
_PIECES_DDL = "file string, start long, outer long, inner long, nested boolean, at long, whole boolean, piece string"


def _cut(begins, outer_depth: int, inner_depth: int | None):
    """Pieces of objects; outer and inner count the block's objects that have begun so far."""

    def run(batches):
        held = {}
        for file, start, _, data in _runs(batches):
            *begun, end = begins.value[file, start]
            quoted, depth, outer, inner, offset = held.get((file, start)) or (*begun, 0, 0, 0)
            data = data[:-1] if offset + len(data) > end >= 0 else data
            if not data:
                continue
            plain, step, quoted_after = _steps(data, quoted)
            after = depth + np.cumsum(step)
            before = after - step
            opens, closes = (plain == ord("{")) & (step > 0), (plain == ord("}")) & (step < 0)
            one = opens & (before == outer_depth)
            two = opens & (before == inner_depth) if inner_depth is not None else np.zeros(len(plain), bool)
            ends = closes & ((after == outer_depth) | (after == (-1 if inner_depth is None else inner_depth)))
            edges = np.unique(np.r_[0, np.flatnonzero(one | two), np.flatnonzero(ends) + 1, len(plain)])
            outers, inners = outer + np.cumsum(one), inner + np.cumsum(two)
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                level = max(before[a], after[a])
                nested = inner_depth is not None and level > inner_depth
                if level <= outer_depth:
                    continue
                piece = data[a:b]
                if inner_depth is not None and not nested:  # commas before and after inner objects go with them
                    piece = piece.lstrip(b", \t\r\n") if before[a] == inner_depth else piece
                    piece = piece.rstrip(b", \t\r\n") if b < len(data) and two[b] else piece
                whole = bool(ends[b - 1]) and bool(two[a] if nested else one[a])
                out.append((file, start, int(outers[a]), int(inners[a]), nested, offset + a, whole, piece.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)
            held[file, start] = (quoted_after, int(after[-1]), int(outers[-1]), int(inners[-1]), offset + len(data))

    return run


def elements(spark: SparkSession, path: str, outer_depth: int, inner_depth: int | None = None, keep=None) -> tuple[DataFrame, DataFrame | None]:
    """((ord, text, first) of the objects that lie outer_depth brackets deep, (ord, inner, text) of those inside them at inner_depth).

    ord counts the outer objects from 0, first is the number of inner objects before
    one, inner counts all of them from 0; an outer object's text is without its inner
    ones. Any other object at these depths is among them, so callers pick by fields.
    A folder's files are parts of one value, by name. `keep` stores the pieces, so that
    they are cut once. No task holds more than its own block and the largest object.
    """
    fragments = _fragments(spark, path)
    summaries = fragments.mapInArrow(_summary, "file string, start long, file_size long, size long, end0 long, deeper0 long, end1 long, deeper1 long").collect()  # a row for each block
    begins = spark.sparkContext.broadcast(_begins(summaries))
    pieces = fragments.mapInArrow(_cut(begins, outer_depth, inner_depth), _PIECES_DDL)
    pieces = keep(pieces) if keep else pieces
    counted = {(r["file"], r["start"]): (r["o"], r["i"]) for r in pieces.groupBy("file", "start").agg(F.max("outer").alias("o"), F.max("inner").alias("i")).collect()}
    base, rows = (0, 0), []
    for r in sorted(summaries, key=lambda r: (r["file"], r["start"])):
        rows.append((r["file"], r["start"], len(rows), *base))
        base = tuple(x + y for x, y in zip(base, counted.get((r["file"], r["start"]), (0, 0))))
    bases = spark.createDataFrame(rows, "file string, start long, block long, o long, i long")
    placed = pieces.join(F.broadcast(bases), ["file", "start"])  # a row for each block
    placed = placed.select((F.col("o") + F.col("outer") - 1).alias("ord"), (F.col("i") + F.col("inner") - 1).alias("inner"), "nested", "block", "at", "whole", "piece")

    def joined(rows: DataFrame, key: list[str]) -> DataFrame:
        """Objects that lie in one block as they are, the pieces of others put together."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda x: x["piece"]), "")
        parts = rows.where("not whole").groupBy(*key).agg(text.alias("text"), F.min("inner").alias("inner_min"))
        return rows.where("whole").select(*key, F.col("piece").alias("text"), F.col("inner").alias("inner_min")).unionByName(parts)

    outer = joined(placed.where("not nested"), ["ord"]).select("ord", "text", (F.col("inner_min") + 1).alias("first"))
    if inner_depth is None:
        return outer, None
    return outer, joined(placed.where("nested"), ["ord", "inner"]).select("ord", "inner", "text")
