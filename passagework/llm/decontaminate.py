"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of whole documents of a partition. Its words are numbered by
the benchmark's vocabulary (0: any other word); runs of known words too short
for any phrase can't match and stay out of the index. The shard's suffix array
gives its Burrows-Wheeler transform, held as a wavelet matrix with rank counts.
All phrases are searched backward at once, their occurrences located by walking
to sampled suffix positions, and the matched spans merged on each document. The
benchmark's phrases are sent to the shards in blocks of a set size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.blobs import cut
from passagework.llm.words import ALNUM, Slab, slabs

#: Most symbols in one index (three ranks of 21 bits make a sort key), and every how many suffixes a position is kept.
MOST_SYMBOLS, SAMPLE = 1 << 20, 8
#: Characters of benchmark text in a block of phrases.
BLOCK_CHARS = 4 << 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; three known ranks are joined in each round, only unresolved suffixes are sorted again."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    sa, ids, slots, k = np.zeros(n, np.int64), np.arange(n), np.arange(n), 1
    s21, s42 = np.uint64(21), np.uint64(42)
    padded = np.zeros(n + 1, np.uint64)
    while len(ids):
        padded[:n] = rank
        key = (padded[ids] << s42) | (padded[np.minimum(ids + k, n)] << s21) | padded[np.minimum(ids + 2 * k, n)]
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        new = np.r_[True, key[1:] != key[:-1]]
        sa[slots] = ids
        rank[ids] = np.maximum.accumulate(np.where(new, slots, 0)).astype(np.uint64) + np.uint64(1)
        open_ = ~(new & np.r_[new[1:], True])
        ids, slots, k = ids[open_], slots[open_], 3 * k
    return sa


class FMIndex:
    """Word symbols 1..sigma-1 in runs that 0 ends; searches don't cross a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        # each 0 is a smaller symbol of its own: no comparison goes past a run's end
        order = symbols.astype(np.int64) + n
        zero = np.flatnonzero(symbols == 0)
        order[zero] = np.arange(len(zero))
        sa = suffix_array(order)
        before = np.where(sa > 0, symbols[sa - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels, x = [], before
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (x >> shift) & 1 > 0
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            self.levels.append((shift, n - int(ones[-1]), ones))
            x = np.concatenate([x[~bit], x[bit]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        kept = (sa % SAMPLE == 0) | (before == 0)
        self.kept, self.before_kept, self.sample = kept, np.cumsum(kept) - 1, sa[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, zeros, ones in self.levels:
            one = ones[at]
            at = np.where((symbol >> shift) & 1 > 0, zeros + one, at - one)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """first[symbol] + rank of symbol before row at."""
        return self.first[symbol] + self._down(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of one length) that occur, with their first and past-the-last rows, by backward search."""
        which = np.arange(len(phrases))
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            c = phrases[which, j]
            low, high = self.step(c, low), self.step(c, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = self.kept[rows]
            out[todo[here]] = self.sample[self.before_kept[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            at, symbol = rows, np.zeros(len(rows), np.int64)
            for shift, zeros, ones in self.levels:  # read the symbol and its rank in one descent
                bit = ones[at + 1] > ones[at]
                symbol |= bit.astype(np.int64) << shift
                at = np.where(bit, zeros + ones[at], at - ones[at])
            rows = self.first[symbol] + at - self.base[symbol]
            steps += 1
        return out


class Phrases:
    """A block of benchmark items: vocabulary, distinct windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        texts = pa.array([text for _, text in items], pa.string())
        hashed: list[np.ndarray] = []
        for slab in slabs(texts, ALNUM, lower=True):
            h = slab.hashes()
            hashed += [h[a:b] for a, b in zip(slab.bounds[:-1], slab.bounds[1:])]
        self.words = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        found: dict[int, dict[tuple, set]] = {}
        for (name, _), h in zip(items, hashed):
            ids = (np.searchsorted(self.words, h) + 1).tolist()
            m = min(width, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(tuple(ids[k : k + m]), set()).add(number[name])
        self.least = min(found, default=0)
        self.by_length = {}
        for m, windows in found.items():
            members = [sorted(x) for x in windows.values()]
            self.by_length[m] = (np.array(list(windows), np.int64), np.array([x for y in members for x in y], np.int64), np.cumsum([0, *map(len, members)]))

    def numbered(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0)


def _shards(symbols: np.ndarray, least: int, longest: int):
    """Blocks of (symbols with a 0 after each run, word index of each symbol)."""
    known = np.r_[0, (symbols > 0).astype(np.int8), 0]
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    start, end = start[long], end[long]
    if len(start) and (end - start).max() >= MOST_SYMBOLS - 1:  # cut with an overlap that holds any phrase
        size, parts = MOST_SYMBOLS // 2, []
        for a, b in zip(start.tolist(), end.tolist()):
            parts += [(k, min(b, k + size + longest - 1)) for k in range(a, max(a + 1, b - longest + 1), size)]
        start, end = (np.array(x) for x in zip(*parts))
    ends = np.cumsum(end - start + 1)
    i = 0
    while i < len(start):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + MOST_SYMBOLS - 1, "right")))
        width = end[i:j] - start[i:j] + 1
        begin = np.cumsum(width) - width
        word = np.repeat(start[i:j] - begin, width) + np.arange(int(width.sum()))
        text = symbols[np.minimum(word, len(symbols) - 1)]
        text[begin + width - 1] = 0
        yield text, word
        i = j


def _hits(slab: Slab, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the slab an occurrence covers; (row, item) pairs."""
    n, rows = len(slab.start), len(slab.bounds) - 1
    depth, pairs = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
    if phrases.least:
        row = np.repeat(np.arange(rows), np.diff(slab.bounds))
        # a gap after each row's last word, so that no run goes from one row into the next
        at = np.arange(n) + row
        symbols = np.zeros(n + rows, np.int64)
        symbols[at] = phrases.numbered(slab.hashes())
        back = np.zeros(n + rows, np.int64)
        back[at] = np.arange(n)
        for text, word in _shards(symbols, phrases.least, max(phrases.by_length)):
            index = FMIndex(text, len(phrases.words) + 1)
            for m, (windows, items, edges) in phrases.by_length.items():
                for k in range(0, len(windows), 1 << 16):
                    which, low, high = index.search(windows[k : k + (1 << 16)])
                    which += k
                    count = high - low
                    for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(count) >> 20)) + 1):
                        if not len(part):
                            continue
                        c = count[part]
                        where = np.repeat(low[part] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                        first = back[word[index.locate(where)]]
                        np.add.at(depth, first, 1)
                        np.add.at(depth, first + m, -1)
                        phrase, doc = np.repeat(which[part], c), row[first]
                        seen = np.unique(doc * np.int64(len(windows)) + phrase)
                        doc, phrase = np.divmod(seen, len(windows))
                        size = edges[phrase + 1] - edges[phrase]
                        item = items[np.repeat(edges[phrase] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                        pairs.append(np.unique(np.stack([np.repeat(doc, size), item], 1), axis=0))
    return np.cumsum(depth)[:n] > 0, np.unique(np.concatenate(pairs), axis=0)


def _spans(hit: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return edge.reshape(-1, 2)


FOUND = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("first", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("cut", pa.string())])


def _without(text: str, slab, r: int, spans: np.ndarray) -> str:
    """A text, row r of the slab, without the words first to end - 1 of each span and what is between them."""
    raw, kept, at = text.encode(), [], 0
    for x, y in spans + slab.bounds[r]:
        kept.append(raw[at : slab.start[x] - slab.offsets[r]])
        at = slab.end[y - 1] - slab.offsets[r]
    return b"".join([*kept, raw[at:]]).decode()


def _cut_merged(batches):
    """Rows of FOUND's columns but for the last, which is the whole text: cut by all spans of the row, whichever block they are from."""
    for batch in batches:
        out, texts = batch.column(6).to_pylist(), batch.column(6)
        for slab in slabs(texts, ALNUM, lower=True):
            for r, (a, b) in enumerate(zip(slab.bounds[:-1], slab.bounds[1:])):
                k = slab.first + r
                first, end = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                if first:
                    hit = np.zeros(int(b - a) + 1, np.int64)
                    np.add.at(hit, first, 1)
                    np.add.at(hit, end, -1)
                    out[k] = _without(out[k], slab, r, _spans(np.cumsum(hit)[:-1] > 0))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.string())], schema=FOUND)


def _find(phrases, with_text: bool):
    def run(batches):
        for batch in batches:
            for slab in slabs(batch.column(2), ALNUM, lower=True):
                hit, pairs = _hits(slab, phrases.value)
                names, texts = phrases.value.names, batch.column(2)
                edge = np.searchsorted(pairs[:, 0], np.arange(slab.stop - slab.first + 1))
                cols = [[] for _ in range(4)]
                for r, (a, b) in enumerate(zip(slab.bounds[:-1], slab.bounds[1:])):
                    spans = _spans(hit[a:b])
                    cols[0].append(spans[:, 0].tolist())
                    cols[1].append(spans[:, 1].tolist())
                    cols[2].append([names[k] for k in pairs[edge[r] : edge[r + 1], 1]])
                    text = None
                    if with_text:
                        text = texts[slab.first + r].as_py()
                        if len(spans):
                            text = _without(text, slab, r, spans)
                    cols[3].append(text)
                part = batch.slice(slab.first, slab.stop - slab.first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(slab.bounds), pa.int64()), *(pa.array(c, FOUND.field(k + 3).type) for k, c in enumerate(cols))], schema=FOUND)

    return run


def _report(rows):
    """Columns from merged spans and items."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("text", pa.string())])
    for batch in rows:
        hit, count, sha = [], [], []
        for first, end, items in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
            done = total = 0
            for a, b in sorted(zip(first, end)):
                total += max(0, b - max(a, done))
                done = max(done, b)
            names = sorted(set(items))
            hit.append(total)
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), batch.column(6)], schema=schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, with_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text (if asked for: without the hit spans).

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
    characters. A window is `width` consecutive words of an item, or the whole item
    if it has fewer, but not none; a document word is hit if an occurrence of a
    window covers it. items_sha256 is of the sorted item ids (strings), comma-joined.
    Null and empty texts have no words; items with null ids count under the name
    "null"; items of one id count once. Repeated documents each have a row. A
    benchmark beyond BLOCK_CHARS goes through the documents in blocks of items, whose
    spans are merged before the text is cut. Other columns are ignored.
    """
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    sc, schema = docs.sparkSession.sparkContext, "key long, doc_id long, n_words long, first array<long>, end array<long>, items array<string>, cut string"
    parts = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = sc.broadcast(Phrases(sorted((r.item_id, r.text) for r in part.toLocalIterator()), width))
        hits = docs.mapInArrow(_find(phrases, with_text and blocks == 1), schema)
        if blocks > 1:  # a block's phrases go before the next one's are sent
            hits = cut(hits)
            phrases.unpersist()
        parts.append(hits)
    found = parts[0]
    if blocks > 1:
        ranked = docs.sparkSession.createDataFrame([], schema)
        for p in parts:
            ranked = ranked.unionByName(p)
        # every block has each row once, so equal rows are counted and divided
        merged = ranked.groupBy("key", "doc_id", "n_words").agg(F.collect_set(F.struct("first", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), (F.count("*") / blocks).cast("int").alias("times"))
        merged = merged.withColumn("first", F.flatten("spans.first")).withColumn("end", F.flatten("spans.end"))
        if with_text:  # every row has its own text, so there is nothing to repeat
            own = docs.withColumnsRenamed({"key": "own_key", "doc_id": "own_id"})
            rows = own.join(merged, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
            found = rows.select("key", "doc_id", "n_words", "first", "end", "items", F.col("text").alias("cut")).mapInArrow(_cut_merged, schema)
        else:
            found = merged.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("key", "doc_id", "n_words", "first", "end", "items", F.lit(None).cast("string").alias("cut"))
    return found.mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, text string")
