"""Removal of word passages that occur again anywhere, by relative Lempel-Ziv parsing.

The corpus is its own reference, and a symbol of the parsing is a window of LENGTH
words. The reference is cut into blocks by content: a window belongs to the block
named by the least hash among its k-word grams, so equal windows always meet in one
block, and a document's fragments (runs of its windows in one block) are parsed
against exactly the blocks that can hold a factor of theirs. In a block all fragments
are indexed by a suffix order. Each fragment is factored greedily: at a position the
longest run of windows that also begins elsewhere in the block is the next factor,
the parsing jumps behind it and looks up the window at that boundary, which reaches
over it, again. A factor of m windows is a passage of LENGTH + m - 1 words, so any
factor is long enough; its words are compared with its source's before it counts. The
union of the factors are the duplicate spans.

Round one finds the block names that occur twice at all, from one entry for each
name and slab of rows; round two sends only fragments of those, as words. Slabs are
parsed by themselves first, and one copy of what repeats goes along, so that a passage
that a third of all documents share costs one entry for each slab; where there are
many slabs, blocks are merged in a tree, each of whose tasks gets a bounded number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.blobs import BLOB_ARROW, BLOB_SCHEMA, bits_for, text_bytes, unpack
from passagework.llm.words import BLANK, SLAB_BYTES, Slab, slabs, windows

GRAM = 12
#: Slabs whose share of a block one task of the tree takes.
FAN = 512
_PAIRS = pa.schema([("key", pa.int64()), ("name", pa.int64())])
_SPANS = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("count", pa.int64())])


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive entries."""
    m, size = g, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - size :][: len(g) - width + 1]) if size < width else m


class _Fragments:
    """Windows of a slab: their hash, block name, row, position in the row, and first word in the slab."""

    def __init__(self, slab: Slab, length: int, named: bool = True):
        h = slab.hashes()
        self.hash, name = windows(h, length), np.zeros(0, np.uint64)
        if named and len(self.hash):
            gram = min(GRAM, length)
            name = _least(windows(h, gram), length - gram + 1)
        n_words = np.diff(slab.bounds)
        row = np.repeat(np.arange(len(n_words)), n_words)[: len(self.hash)]
        at = np.arange(len(self.hash))
        inside = at + length <= slab.bounds[row + 1] if len(row) else np.zeros(0, bool)
        self.hash, self.row, self.at = self.hash[inside], row[inside], at[inside]
        self.name = name[inside] if named else self.row.astype(np.uint64)
        self.pos = self.at - slab.bounds[self.row]

    def cut(self, keep: np.ndarray) -> None:
        self.hash, self.name, self.row, self.pos, self.at = (x[keep] for x in (self.hash, self.name, self.row, self.pos, self.at))

    def runs(self, *also: np.ndarray) -> np.ndarray:
        """Where a new run of consecutive windows of one row and block begins."""
        if not len(self.row):
            return np.zeros(0, np.int64)
        new = (self.row[1:] != self.row[:-1]) | (self.pos[1:] != self.pos[:-1] + 1) | (self.name[1:] != self.name[:-1])
        for x in also:
            new |= x[1:] != x[:-1]
        return np.flatnonzero(np.r_[True, new])


def _repeated(x: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    if not len(x):
        return np.zeros(0, bool)
    order = np.argsort(x)
    s = x[order]
    same = np.r_[False, s[1:] == s[:-1]]
    out = np.empty(len(x), bool)
    out[order] = same | np.r_[same[1:], False]
    return out


def _rows(pairs) -> list[pa.RecordBatch]:
    pairs = list(pairs)
    return [pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs[a : a + 512]], pa.int32()), pa.array([p[1] for p in pairs[a : a + 512]], pa.binary())], schema=BLOB_ARROW) for a in range(0, len(pairs), 512)]


def _packed(name: np.ndarray, columns: list[np.ndarray], bits: int, lengths: np.ndarray | None = None, payload: np.ndarray | None = None):
    """(bucket, blob) by leading bits of name; lengths says how much of payload each entry has."""
    order = np.argsort(name, kind="stable")
    if lengths is not None:
        begin = np.cumsum(lengths) - lengths
        lengths, begin = lengths[order], begin[order]
        ends = np.cumsum(lengths)
        payload = payload[np.repeat(begin - (ends - lengths), lengths) + np.arange(len(payload))]
    name, columns = name[order], [c[order] for c in columns]
    bucket = (name >> np.uint64(64 - bits)).astype(np.int32)
    rest = ((name << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(name)]
    for a, b in zip(edges[:-1], edges[1:]):
        parts = [np.uint32(b - a).tobytes(), rest[a:b].tobytes(), *(c[a:b].tobytes() for c in columns)]
        if lengths is not None:
            parts += [lengths[a:b].astype("<u4").tobytes(), payload[ends[a] - lengths[a] : ends[b - 1]].tobytes()]
        yield int(bucket[a]), b"".join(parts)


def _short(name: np.ndarray, bits: int) -> np.ndarray:
    """What buckets and blobs keep of a name."""
    return (name >> np.uint64(32 - bits)).astype(np.int64)


def _settled(key: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """Results that need no other task, under buckets past the hash ranges that hand them on."""
    at = (1 << bits) + int(np.uint64(key[0].view(np.uint64)) % np.uint64(1 << bits)) if len(key) else 0
    return [(at, key.astype("<i8").tobytes() + a.astype("<i8").tobytes() + b.astype("<i8").tobytes())] if len(key) else []


def _names(length: int, bits: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for slab in slabs(batch.column(1), BLANK, slab_bytes=SLAB_BYTES):
                f = _Fragments(slab, length)
                head = f.runs()
                if not len(head):
                    continue
                name, key = f.name[head], keys[slab.first + f.row[head]]
                known = _repeated(name) | np.logical_or.reduceat(_repeated(f.hash), head)
                short, which = np.unique(name, return_index=True)
                yield from _rows([*_packed(short, [key[which], known[which].astype("u1")], bits), *_settled(key[known], _short(name[known], bits), name[known].astype(np.int64), bits)])

    return run


def _repeated_names(bits: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
        if bucket >= 1 << bits:
            parts = [np.frombuffer(x, "<i8").reshape(3, -1) for x in blobs]
            key, name = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        else:
            rest, key, known = unpack(blobs, ["<i8", "u1"])
            order = np.argsort(rest, kind="stable")
            rest, key, known = rest[order], key[order], known[order] > 0
            same = np.r_[False, rest[1:] == rest[:-1]]
            again = (same | np.r_[same[1:], False]) & ~known
            key, name = key[again], (np.int64(bucket) << 32) + rest[again].astype(np.int64)
        return pa.Table.from_arrays([pa.array(key, pa.int64()), pa.array(name, pa.int64())], schema=_PAIRS)

    return run


def longest_matches(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest run of symbols from it that also begins elsewhere, and one such place (-1 without any).

    ends: for each position the end of its fragment, which no run crosses. Positions are put
    into suffix order by doubling; a position's longest match begins at one of its two
    neighbours there, and the ranks of runs of 1, 2, 4, ... symbols measure it.
    """
    m, here = len(symbols), np.flatnonzero(_repeated(symbols))  # the others match nothing and end any run
    length, source = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    n = len(here)
    if not n:
        return length, source
    new = np.r_[True, (np.diff(here) > 1) | (ends[here][1:] != ends[here][:-1])]
    head = np.flatnonzero(new)
    stop = np.repeat(np.r_[head[1:], n], np.diff(np.r_[head, n]))
    at, ranks, size = np.arange(n), [np.unique(symbols[here], return_inverse=True)[1].astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        full = rank[at + size <= stop]
        if not len(full) or np.bincount(full).max() < 2:  # no run of this size comes twice
            break
        second = np.where(at + size < stop, rank[np.minimum(at + size, n - 1)], -1)
        ranks.append(np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    x, y = a.copy(), b.copy()
    for k in range(len(ranks) - 1, -1, -1):
        u, v = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same = (x + (1 << k) <= stop[a]) & (y + (1 << k) <= stop[b]) & (ranks[k][u] == ranks[k][v])
        x, y = x + (same << k), y + (same << k)
    common, best, place = x - a, np.zeros(n, np.int64), np.full(n, -1, np.int64)
    best[a], place[a] = common, b
    more = common > best[b]
    best[b[more]], place[b[more]] = common[more], a[more]
    length[here], source[here] = best, here[place]
    return length, source


def parse(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all fragments: where each begins, its source, its length. Positions without a match are literals and left out."""
    length, source = longest_matches(symbols, ends)
    m = len(symbols)
    # from a literal the parsing goes on at the next position that has a match
    matched = np.append(np.where(length > 0, np.arange(m), m), m)
    following = np.minimum.accumulate(matched[::-1])[::-1]
    stop, place = np.unique(ends, return_index=True)
    found = []
    while len(place):
        place = following[place]
        go = place < stop
        place, stop = place[go], stop[go]
        found.append(place)
        place = place + length[place]
    begin = np.concatenate(found) if found else np.zeros(0, np.int64)
    return begin, source[begin], length[begin]


def duplicates(f: _Fragments, slab: Slab, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie in a factor whose words are its source's, and which share a hash with other words."""
    head = f.runs()
    size = np.diff(np.r_[head, len(f.hash)])
    begin, source, count = parse(f.hash, np.repeat(head + size, size))
    hit, odd = np.zeros(len(f.hash) + 1, np.int64), np.zeros(len(f.hash), bool)
    if not len(begin):
        return odd.copy(), odd
    data, start, end = slab.data.tobytes(), slab.start, slab.end
    # words are joined by one space here, so equal bytes are equal words
    a, b, last = start[f.at[begin]], start[f.at[source]], count + length - 2
    c, d = end[f.at[begin] + last], end[f.at[source] + last]
    equal = np.fromiter((data[i:j] == data[k:l] for i, j, k, l in zip(a.tolist(), c.tolist(), b.tolist(), d.tolist())), bool, len(begin))
    np.add.at(hit, begin[equal], 1)
    np.add.at(hit, begin[equal] + count[equal], -1)
    hit = np.cumsum(hit[:-1]) > 0
    if not equal.all():  # two hashes collide: their windows are compared one by one
        text = lambda i: data[start[f.at[i]] : end[f.at[i] + length - 1]]
        shared = np.isin(f.hash, f.hash[np.concatenate([np.arange(x, x + n) for x, n in zip(begin[~equal], count[~equal])])])
        held: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(shared).tolist():
            held.setdefault(text(i), []).append(i)
        odd |= shared
        for places in held.values():
            hit[places] = len(places) > 1
    return hit, odd


def plain(slab: Slab, rows: int) -> Slab:
    """The slab's words joined by one space, in rows as they were."""
    size = slab.end - slab.start + 1
    end = np.cumsum(size)
    data = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    start, end = end - size, end - 1
    within = np.arange(len(data)) - np.repeat(start, size)
    word = within < np.repeat(size - 1, size)
    data[word] = slab.data[(np.repeat(slab.start, size) + within)[word]]
    return Slab(0, rows, data, None, start, end, slab.bounds)


def _handed_on(f: _Fragments, slab: Slab, hit: np.ndarray, odd: np.ndarray, known: np.ndarray, keys: np.ndarray, first: np.ndarray, length: int, bits: int) -> list[tuple[int, bytes]]:
    """Spans of the windows that are hit and weren't known before, and one fragment of each different window as a source for others."""
    out, new = [], np.flatnonzero(hit & ~known)
    if len(new):
        head = np.flatnonzero(np.r_[True, (f.row[new][1:] != f.row[new][:-1]) | (f.pos[new][1:] != f.pos[new][:-1] + 1)])
        row = f.row[new[head]]
        out += _settled(keys[row], first[row] + f.pos[new[head]], np.diff(np.r_[head, len(new)]), bits)
    settled, one = hit | known, odd.copy()
    one[np.unique(f.hash, return_index=True)[1]] = True
    f.cut(one)
    settled = settled[one]
    head = f.runs(settled)
    if len(head):
        count = np.diff(np.r_[head, len(f.hash)])
        a, b = slab.start[f.at[head]], slab.end[f.at[head] + count + length - 2]
        size = b - a
        payload = slab.data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        row = f.row[head]
        out += _packed(f.name[head], [keys[row], (first[row] + f.pos[head]).astype("<u4"), settled[head].astype("u1")], bits, size, payload)
    return out


def _sent(length: int, bits: int):
    """Fragments of repeated names; what repeats in the slab is settled, one copy of it goes along as a source."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted, at = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            for slab in slabs(batch.column(1), BLANK, slab_bytes=SLAB_BYTES):
                f, rows = _Fragments(slab, length), slab.stop - slab.first
                short, keep = _short(f.name, bits), np.zeros(len(f.name), bool)
                edge = np.searchsorted(f.row, np.arange(rows + 1))
                for r in range(rows):
                    if edge[r] < edge[r + 1]:
                        keep[edge[r] : edge[r + 1]] = np.isin(short[edge[r] : edge[r + 1]], wanted[at[slab.first + r] : at[slab.first + r + 1]])
                f.cut(keep)
                if len(f.hash):
                    words = plain(slab, rows)
                    hit, odd = duplicates(f, words, length)
                    yield from _rows(_handed_on(f, words, hit, odd, np.zeros(len(hit), bool), keys[slab.first : slab.stop], np.zeros(rows, np.int64), length, bits))

    return run


def _opened(bucket: int, blobs: list[bytes], length: int, bits: int):
    """A block's fragments as a slab, and the names, keys, first positions and known flags of its rows."""
    rest, keys, starts, known, sizes, texts = [], [], [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        at = 4 + 4 * n
        rest.append(np.frombuffer(blob, "<u4", n, 4))
        keys.append(np.frombuffer(blob, "<i8", n, at))
        starts.append(np.frombuffer(blob, "<u4", n, at + 8 * n))
        known.append(np.frombuffer(blob, "u1", n, at + 12 * n))
        sizes.append(np.frombuffer(blob, "<u4", n, at + 13 * n))
        texts.append(blob[at + 17 * n :])
    rest, keys, starts, known, sizes = (np.concatenate(x) for x in (rest, keys, starts, known, sizes))
    offsets = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    column = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(texts))])
    slab = next(slabs(column, BLANK, slab_bytes=1 << 62))
    f = _Fragments(slab, length, named=False)
    name = (np.uint64(bucket) << np.uint64(64 - bits)) | (rest.astype(np.uint64) << np.uint64(32 - bits))
    return f, slab, name, keys, starts.astype(np.int64), known > 0


def _merged(length: int, bits: int):
    """One step of the tree: a part of a block is parsed, and handed on like a slab."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
        if bucket >= 1 << bits:
            return table.select(["bucket", "blob"])
        f, slab, name, keys, first, known = _opened(bucket, blobs, length, bits)
        hit, odd = duplicates(f, slab, length)
        known = known[f.row]
        f.name = name[f.row]
        out = _rows(_handed_on(f, slab, hit, odd, known, keys, first, length, bits))
        return pa.Table.from_batches(out, BLOB_ARROW)

    return run


def _factors(length: int, bits: int):
    """Spans of all windows of a block that are in a factor and weren't settled before."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
        if bucket >= 1 << bits:
            parts = [np.frombuffer(x, "<i8").reshape(3, -1) for x in blobs]
            key, first, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        else:
            f, slab, _, keys, starts, known = _opened(bucket, blobs, length, bits)
            hit = np.flatnonzero(duplicates(f, slab, length)[0] & ~known[f.row])
            head = np.flatnonzero(np.r_[True, (f.row[hit][1:] != f.row[hit][:-1]) | (f.pos[hit][1:] != f.pos[hit][:-1] + 1)]) if len(hit) else hit
            row = f.row[hit[head]]
            key, first, count = keys[row], starts[row] + f.pos[hit[head]], np.diff(np.r_[head, len(hit)]) if len(hit) else hit
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (key, first, count)], schema=_SPANS)

    return run


def _kept(length: int, with_text: bool, id_type):
    fields = [("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            first, count = batch.column(2), batch.column(3)
            texts, out = batch.column(1), [[] for _ in range(4)]
            for i in range(len(batch)):
                text = texts[i].as_py()
                words = (text or "").encode().split()
                gone = 0
                if first[i].is_valid:
                    # rows of one key have one text but for a collision of hashes, whose spans are cut off here
                    a = np.minimum(first[i].values.to_numpy(zero_copy_only=False), len(words))
                    b = np.minimum(a + count[i].values.to_numpy(zero_copy_only=False) + length - 1, len(words))
                    depth = np.cumsum(np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1))[: len(words)]
                    kept = [w for w, d in zip(words, (depth > 0).tolist()) if not d]
                    gone = len(words) - len(kept)
                else:
                    kept = words
                joined = b" ".join(kept)
                out[0].append(len(words))
                out[1].append(gone)
                out[2].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out[3].append(joined.decode() if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), *([pa.array(out[3], pa.string())] * with_text)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, with_text: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, text (what is kept).

    A word goes if a window of `length` consecutive words that covers it also
    starts anywhere else, in the same document or another; windows are judged on
    the input. Kept words are joined by one space; a text without removals is kept
    as it is. Null, empty and short texts lose nothing (null has no words and stays
    null). Repeated rows repeat each other, so all their windows go. Ids are
    integers, may be null or repeated, and only name the result's rows. Rows are told
    apart by a 64-bit hash of id and text. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = text_bytes(docs, "text")
    bits, parts = bits_for(total), 1 + total // SLAB_BYTES
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    names = keyed.select("key", "text").mapInArrow(_names(length, bits), BLOB_SCHEMA).groupBy("bucket").applyInArrow(_repeated_names(bits), "key long, name long")
    wanted = names.groupBy("key").agg(F.collect_set("name").alias("names"))
    # doc_id goes along so that both joins with texts read one exchange
    blocks = keyed.join(wanted, "key").select("key", "text", "names", "doc_id").mapInArrow(_sent(length, bits), BLOB_SCHEMA)
    while parts > FAN:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(parts))).groupBy("bucket", "part").applyInArrow(_merged(length, bits), BLOB_SCHEMA)
    spans = blocks.groupBy("bucket").applyInArrow(_factors(length, bits), "key long, first long, count long")
    # equal rows have one key and each tell its spans: a set holds them once, already in the tasks that found them
    marked = spans.groupBy("key").agg(F.collect_set(F.struct("first", "count")).alias("spans")).select("key", F.col("spans.first").alias("first"), F.col("spans.count").alias("count"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return keyed.join(marked, "key", "left").select("doc_id", "text", "first", "count").mapInArrow(_kept(length, with_text, pa.int64()), schema)
