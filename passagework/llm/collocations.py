"""Phrase collocations, counted by slots of a minimal perfect hash.

1. One pass counts words and neighbouring pairs roughly: in an array that each adds to
   at a place of its hash, so that a sum below the threshold rules all at this place
   out. A second pass counts the words that are left, and roughly the longer phrases
   whose words and pairs are all left.
2. A pass names the candidates: phrases whose words are all frequent and whose parts
   all pass the arrays, as they do. No other phrase can be frequent.
3. The candidates get a minimal perfect hash. A pass looks each occurrence up, compares
   the key that is stored in the slot (other phrases have slots too), and counts by
   bincount. The arrays of all tasks are summed up in a tree, in blocks of slots.
4. A pass reads the frequent phrases' words; their parts' counts are read by slot.

Tasks can't hold any number of candidates: the SLOTS of them that most parts of the
corpus hold have slots; occurrences of the rest are counted in each task and summed
by key. Filters are bitmaps of bounded size, which let more through in a larger
corpus; this costs time and changes no count. Phrases are told apart by 64-bit hashes
of words and language; two of some 10^9 frequent ones share one with probability 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.blobs import bits_for, cut, text_bytes
from passagework.llm.words import LOWER, mix, slabs, windows

#: Bytes that end a piece, and those that belong to no word.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"]] = ENDS[0x0A:0x0E] = True
IN_WORD = ~ENDS
IN_WORD[[0x20, 0x09]] = False
#: Words of the longest phrase.
LONGEST = 4
#: Candidates that tasks count by slot.
SLOTS = 1 << 21
#: Bits of the rough counts' array: one place for so many bytes of text, within these powers of two.
BYTES_A_PLACE, LEAST_ROUGH, MOST_ROUGH = 64, 16, 26
#: Bits of the bitmaps of frequent words and phrases: so many for each, within these powers of two.
BITS_A_KEY, LEAST_BITMAP, MOST_BITMAP = 16, 16, 27
#: Keys gathered in a task before they are merged and sent.
FLUSH = 1 << 20
#: Slots and places in a block of an array, and the arrays that a task of the tree sums up.
BLOCK, FAN = 1 << 14, 64
#: Parts of a language's phrases that are ranked before all are.
SALT = 64


class SlotTable:
    """A minimal perfect hash of distinct 64-bit keys, with the keys by slot.

    On each level a key has one place; those alone at theirs stay, the others go on to
    the next. A slot is the number of places that are taken before the key's.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels, base, rest = np.zeros(len(keys), np.uint64), [], 0, keys
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            taken = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, base + np.cumsum(taken) - taken))
            stays = alone[at]
            self.keys[self._slots(at[stays], -1)] = rest[stays]
            base, rest = base + int(taken.sum()), rest[~stays]

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (((mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def _slots(self, at: np.ndarray, level: int) -> np.ndarray:
        _, words, before = self.levels[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for keys that the slot's stored key isn't."""
        found, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, _) in enumerate(self.levels):
            at = self._place(keys[rest], level, size)
            taken = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            found[rest[taken]] = self._slots(at[taken], level)
            rest = rest[~taken]
        inside = np.flatnonzero(found >= 0)
        other = self.keys[found[inside]] != keys[inside]
        found[inside[other]] = -1
        return found


# --- phrases of a batch ----------------------------------------------------


def _language(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 11))


def _split(batches):
    """(batch rows' languages, slab, row of each word, number of its piece, hash of word and language) for (lang, text) rows."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        known = {name: _language(name) for name in set(langs)}
        for slab in slabs(batch.column(1), IN_WORD, lower=True):
            row = np.repeat(np.arange(slab.first, slab.stop), np.diff(slab.bounds))
            piece = np.cumsum(ENDS[slab.data])[slab.start] + row if len(row) else row
            own = np.array([known[x] for x in langs[slab.first : slab.stop]], np.uint64)
            yield langs, slab, row, piece, mix(slab.hashes() ^ own[row - slab.first])


def _inside(piece: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from here on are of one piece."""
    return piece[n - 1 :] == piece[: len(piece) - n + 1] if len(piece) >= n else np.zeros(0, bool)


def _safe(piece: np.ndarray, h: np.ndarray, filters):
    """(n, places, keys) of the words and phrases up to LONGEST words that can be frequent: they and their parts pass the filters, one for each length from 1 on."""
    alive = np.ones(len(h), bool)
    for n in range(1, LONGEST + 1):
        if len(h) < n:
            return
        if n > 1:
            alive = alive[1:] & alive[:-1]
        if n == 2:  # longer phrases consist of pairs
            alive &= _inside(piece, 2)
        at = np.flatnonzero(alive)
        keys = windows(h, n)[at]
        if n <= len(filters):
            passed = _in_bitmap(filters[n - 1], keys)
            alive[at[~passed]] = False
            at, keys = at[passed], keys[passed]
        yield n, at, keys


def _in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of keys (their leading bits) are set."""
    at = (keys >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


# --- packed keys, counts and arrays ----------------------------------------

_KEYED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("lang", pa.string()), ("count", pa.int64()), ("blob", pa.binary())])
_KEYED_DDL = "bucket int, part int, lang string, count long, blob binary"
#: Kinds of rows, where a task returns several: part is -1 for a language's words, the number of the array's task, or -2 and less for keys of task 0 and more.
LANGUAGE, KEYS = -1, -2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _KEYED)], schema=_KEYED)


def _dealt(keys: np.ndarray, counts: np.ndarray | None, bits: int):
    """Rows of ascending keys and counts, if there are any, a row for each bucket (the keys' leading bits): seven bytes of each key, and counts in the least width."""
    bucket, part = (keys >> np.uint64(64 - bits)).astype(np.int64), KEYS - _task()
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    rest = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            width = 0 if counts is None else next(w for w in (1, 2, 4) if int(counts[a:b].max()) < 1 << (8 * w))
            rows.append((int(bucket[a]), part, None, b - a, rest[a:b].tobytes() + (counts[a:b].astype(f"<u{width}").tobytes() if width else b"")))
    for k in range(0, len(rows), 1024):
        yield _rows(rows[k : k + 1024])


def _undealt(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums, number of rows they were in, a task that has them) of a bucket."""
    keys, counts, owners, first = [], [], [], np.uint64(table.column("bucket")[0].as_py() >> (bits - 8))
    for n, part, blob in zip(*(table.column(c).to_pylist() for c in ("count", "part", "blob"))):
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :7] = np.frombuffer(blob, np.uint8, 7 * n).reshape(n, 7)
        keys.append(whole.view("<u8").ravel() | (first << np.uint64(56)))
        width = (len(blob) - 7 * n) // n
        counts.append(np.frombuffer(blob, f"<u{width}", n, 7 * n).astype(np.int64) if width else np.zeros(n, np.int64))
        owners.append(np.full(n, KEYS - part, np.int64))
    found, one, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return found, sums, np.bincount(at, minlength=len(found)), np.concatenate(owners)[one]


class _Gathered:
    """Distinct keys with counts, sent when they are many."""

    def __init__(self, bits: int, counted: bool = True):
        self.bits, self.counted, self.new, self.size, self.keys, self.counts = bits, counted, [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray):
        self.new.append(keys)
        self.size += len(keys)
        if self.size >= FLUSH:
            self._merge()
            if len(self.keys) >= FLUSH:
                yield from self.rest()

    def _merge(self) -> None:
        all_keys = np.concatenate([self.keys, *self.new])
        weights = np.concatenate([self.counts, np.ones(len(all_keys) - len(self.counts), np.int64)])
        self.keys, at = np.unique(all_keys, return_inverse=True)
        self.counts, self.new, self.size = np.zeros(len(self.keys), np.int64), [], 0
        np.add.at(self.counts, at, weights)

    def rest(self):
        self._merge()
        while len(self.keys):  # a count that passes 32 bits is sent in several rows
            yield from _dealt(self.keys, np.minimum(self.counts, 0xFFFFFFFF) if self.counted else None, self.bits)
            more = self.counts > (0xFFFFFFFF if self.counted else np.iinfo(np.int64).max - 1)
            self.keys, self.counts = self.keys[more], self.counts[more] - 0xFFFFFFFF


def _encoded(counts: np.ndarray) -> bytes:
    """A block of an array in the fewest bytes: its places that aren't 0 by number or as a bitmap, or all; in the least width that holds the largest."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max()) < 1 << (8 * w))
    at = np.flatnonzero(counts)
    held = counts[at].astype(f"<u{width}").tobytes()
    forms = {0: 2 * len(at) + len(held), 16: len(counts) * width, 32: (len(counts) + 7) // 8 + len(held)}
    form = min(forms, key=forms.get)
    if form == 16:
        return bytes([16 + width]) + counts.astype(f"<u{width}").tobytes()
    return bytes([form + width]) + (np.packbits(counts > 0).tobytes() if form else at.astype("<u2").tobytes()) + held


def _decoded(blob: bytes, size: int) -> np.ndarray:
    width, form, out = blob[0] & 15, blob[0] & 48, np.zeros(size, np.int64)
    if form == 16:
        return np.frombuffer(blob, f"<u{width}", size, 1).astype(np.int64)
    if form == 32:
        bits = (size + 7) // 8
        at = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, bits, 1), count=size))
        out[at] = np.frombuffer(blob, f"<u{width}", len(at), 1 + bits)
    else:
        n = (len(blob) - 1) // (2 + width)
        out[np.frombuffer(blob, "<u2", n, 1)] = np.frombuffer(blob, f"<u{width}", n, 1 + 2 * n)
    return out


def _array_rows(counts: np.ndarray, part: int):
    for a in range(0, len(counts), BLOCK):
        block = counts[a : a + BLOCK]
        if block.any():
            yield _rows([(a // BLOCK, part, None, len(block), _encoded(block.astype(np.int64)))])


def _tree_sum(arrays: DataFrame, most: int | None) -> DataFrame:
    """(bucket, part, count, blob, owner), one row for each block: the sums of all tasks' arrays, FAN at a time, and one more than a task in which a place isn't 0; sums above `most` count as that."""
    schema = pa.schema([f for f in _KEYED if f.name != "lang"] + [pa.field("owner", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        size, total, owner = table.column("count")[0].as_py(), 0, 0
        for part, blob, named in zip(*(table.column(c).to_pylist() for c in ("part", "blob", "owner"))):
            counts = _decoded(blob, size)
            total = total + counts
            owner = np.maximum(owner, (counts > 0) * (part + 1) if named is None else _decoded(named, size))
        total = total if most is None else np.minimum(total, most)
        row = (table.column("bucket")[0].as_py(), table.column("part")[0].as_py() // FAN, size, _encoded(total), _encoded(owner) if most is None else None)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    parts = (arrays.agg(F.max("part")).first()[0] or 0) + 1
    arrays = arrays.drop("lang").withColumn("owner", F.lit(None).cast("binary"))
    while True:
        arrays = arrays.groupBy("bucket", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(run, "bucket int, part int, count long, blob binary, owner binary")
        parts = -(-parts // FAN)
        if parts == 1:
            return arrays


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# --- passes ----------------------------------------------------------------


class _Rough:
    """An array of rough counts, none of which passes the roof."""

    def __init__(self, size: int, roof: int):
        self.counts, self.roof, self.held, self.size = np.zeros(size, np.uint8), roof, [], 0

    def add(self, at: np.ndarray) -> None:
        self.held.append(at.astype(np.uint32))
        self.size += len(at)
        if self.size >= FLUSH:
            self._spread()

    def _spread(self) -> None:
        at, c = np.unique(np.concatenate(self.held), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + c, self.roof)
        self.held, self.size = [], 0

    def rest(self):
        if self.held:
            self._spread()
        yield from _array_rows(self.counts, _task())


def _counted_roughly(rough_bits: int, roof: int):
    """Words of each language, and the array of rough counts of words and, behind them, of pairs."""

    def run(batches):
        total, rough, shift = {}, _Rough(2 << rough_bits, roof), np.uint64(64 - rough_bits)
        for langs, slab, row, piece, h in _split(batches):
            found, c = np.unique(row, return_counts=True)
            for k, n in zip(found.tolist(), c.tolist()):
                total[langs[k]] = total.get(langs[k], 0) + n
            rough.add(windows(h, 1) >> shift)
            rough.add((windows(h, 2)[_inside(piece, 2)] >> shift) + np.uint64(1 << rough_bits))
        if total:
            yield _rows([(0, LANGUAGE, name, n, None) for name, n in total.items()])
        yield from rough.rest()

    return run


def _counted_words(bits: int, rough_bits: int, roof: int, filters):
    """Counts by key of the words that are left, and the array of rough counts of phrases of three words and, behind them, of more."""

    def run(batches):
        words, rough, shift = _Gathered(bits), _Rough(2 << rough_bits, roof), np.uint64(64 - rough_bits)
        for _, _, _, piece, h in _split(batches):
            for n, _, keys in _safe(piece, h, filters.value):
                if n == 1:
                    yield from words.add(keys)
                elif n > 2:
                    rough.add((keys >> shift) + np.uint64((n > 3) << rough_bits))
        yield from words.rest()
        yield from rough.rest()

    return run


def _candidates(bits: int, filters):
    def run(batches):
        found = _Gathered(bits, False)
        for _, _, _, piece, h in _split(batches):
            for n, _, keys in _safe(piece, h, filters.value):
                if n > 1:
                    yield from found.add(keys)
        yield from found.rest()

    return run


def _by_slot(bits: int, filters, table):
    """The array of candidates' counts, and other candidates' counts by key."""

    def run(batches):
        slots, rest, held, size = table.value, _Gathered(bits), [], 0
        counts = np.zeros(len(slots), np.int64)
        for _, _, _, piece, h in _split(batches):
            for n, _, keys in _safe(piece, h, filters.value):
                if n == 1:
                    continue
                at = slots.find(keys)
                held.append(at[at >= 0])
                size += len(held[-1])
                yield from rest.add(keys[at < 0])
            if size >= max(FLUSH, len(slots)):
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        yield from rest.rest()
        yield from _array_rows(counts, _task())

    return run


def _mark(keys: np.ndarray, owners) -> np.ndarray:
    """Names a key together with a task."""
    return mix(keys ^ mix(np.asarray(owners).astype(np.uint64) + np.uint64(1)))


def _spelled(filters, wanted):
    """(lang, phrase) of frequent phrases, from the task that was named as having each; with owners None from every task."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string())])

    def run(batches):
        slots, owners, bitmap = wanted.value
        me, told = _task(), np.zeros(len(slots), bool)
        late = np.zeros(0, np.uint64)
        for langs, slab, row, piece, h in _split(batches):
            out = []
            for n, places, keys in _safe(piece, h, filters.value):
                if n == 1:
                    continue
                keys, first = np.unique(keys, return_index=True)
                places, at = places[first], slots.find(keys)
                fresh = np.flatnonzero(at >= 0)
                fresh = fresh[~told[at[fresh]] & (owners is None or owners[at[fresh]] == me)]
                told[at[fresh]] = True
                others = np.flatnonzero(at < 0) if len(bitmap) else np.zeros(0, np.int64)
                others = others[_in_bitmap(bitmap, _mark(keys[others], me))] if len(others) else others
                others = others[~np.isin(keys[others], late)]
                if len(others):
                    late = np.r_[late, keys[others]] if len(late) < FLUSH else keys[others]
                for p in np.r_[places[fresh], places[others]].tolist():
                    out.append((langs[row[p]], b" ".join(slab.word(p + k) for k in range(n)).decode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], schema=schema)

    return run


_CUTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64())])


def _cuts(read):
    """A row for each phrase and cut: keys and counts of the whole and its two parts; counts of keys without a slot are null."""

    def run(batches):
        slots, held = read.value
        for batch in batches:
            names, lang, k, key, left, right = batch.column(1).to_pylist(), [], [], [], [], []
            phrases = []
            for _, slab, row, _, h in _split([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["lang", "text"])]):
                sizes, grams = np.diff(slab.bounds), {n: windows(h, n) for n in range(1, LONGEST + 1)}
                for r, (at, n) in enumerate(zip(slab.bounds[:-1].tolist(), sizes.tolist()), slab.first):
                    for c in range(1, n):
                        phrases.append(names[r])
                        lang.append(batch.column(0)[r].as_py())
                        k.append(c)
                        key.append(grams[n][at])
                        left.append(grams[c][at])
                        right.append(grams[n - c][at + c])
            columns = [np.array(x, np.uint64) for x in (key, left, right)]
            found = [slots.find(x) for x in columns]
            counts = [pa.array(np.where(s >= 0, held[s], 0), pa.int64(), mask=s < 0) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.string()), pa.array(k, pa.int32()), *(pa.array(x.view(np.int64)) for x in columns), *counts], schema=_CUTS)

    return run


_COUNTED, _COUNTED_DDL = pa.schema([(c, pa.int64()) for c in ("key", "count", "owner", "mark")]), "key long, count long, owner long, mark long"


def _counted_rows(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(owners), pa.array(_mark(keys, owners).view(np.int64))], schema=_COUNTED)


def _sums(least: int, bits: int):
    """A bucket's keys that reach the least count, each with a task that has it."""

    def run(table: pa.Table) -> pa.Table:
        keys, sums, _, owners = _undealt(table, bits)
        keep = sums >= least
        return pa.Table.from_batches([_counted_rows(keys[keep], sums[keep], owners[keep])])

    return run


def _seen(bits: int):
    """The same with the number of rows of tasks that a bucket's keys were in, for all of them."""

    def run(table: pa.Table) -> pa.Table:
        keys, _, rows, owners = _undealt(table, bits)
        return pa.Table.from_batches([_counted_rows(keys, rows.astype(np.int64), owners)])

    return run


def _bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap of keys(key), made of words of 64 bits; its size is bounded, whatever their number."""
    bits = max(LEAST_BITMAP, min(MOST_BITMAP, (BITS_A_KEY * count).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    found = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[_column(found, "word")] = _column(found, "bits").view(np.uint64)
    return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _most(rows: DataFrame, room: int) -> DataFrame:
    """Of rows(key, count) those with the largest counts, no more than about `room`; of equal counts those with the least hashes of their keys."""
    classes, taken, least, share = rows.groupBy(F.least("count", F.lit(1 << 16)).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect(), 0, 1 << 17, 0.0
    for c in classes:  # 2^16 classes at most
        if taken + c["n"] > room:
            share = (room - taken) / c["n"]
            break
        taken, least = taken + c["n"], c["class"]
    level = F.least("count", F.lit(1 << 16))
    below = max((c["class"] for c in classes if c["class"] < least), default=0)
    return rows.where((level >= least) | ((level == below) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * 0.99 * (1 << 20)))))


def _with_counts(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of cuts whose counts aren't all known, with the counts of their keys."""
    for key, count in (("key", "a"), ("left", "l"), ("right", "r")):
        cuts = cuts.drop(count).join(counts.select(F.col("key").alias(f"_{key}"), F.col("count").alias(count)), F.col(key) == F.col(f"_{key}")).drop(f"_{key}")
    return cuts


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 * a / (l + r)), in decimals of 38 digits."""
    wide = "decimal(38,0)"
    return F.call_function("div", (a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")).cast(wide), (l.cast(wide) + r.cast(wide)).cast(wide))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to 4 words.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces,
    these at spaces and tabs into words; null texts have none, a null language is
    `und`. n is the number of the language's words, a the phrase's occurrences within
    pieces, overlaps included; phrases with `least` or more take part. A cut into two
    parts that occur l and r times scores floor(2000000 * a / (l + r)); the lowest cut
    counts, of equal ones the first. Phrases that lie inside a longer one with
    80 % or more of their occurrences are left out. Ranks go by score and a, both
    descending, and phrase (byte order). Repeated rows count each; other columns are
    ignored; a table without words gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    spark, total = docs.sparkSession, text_bytes(docs, "text")
    bits, rough_bits = bits_for(total), max(LEAST_ROUGH, min(MOST_ROUGH, (total // BYTES_A_PLACE).bit_length()))
    share = spark.sparkContext.broadcast

    roof = min(255, least)
    first = cut(docs.mapInArrow(_counted_roughly(rough_bits, roof), _KEYED_DDL))
    by_key = lambda rows, run: rows.where(F.col("part") <= KEYS).groupBy("bucket").applyInArrow(run, _COUNTED_DDL)
    langs = first.where(F.col("part") == LANGUAGE).groupBy("lang").agg(F.sum("count").alias("n"))
    left_words, left_pairs = _rough_bitmaps(first.where("part >= 0"), least, rough_bits)
    second = cut(docs.mapInArrow(_counted_words(bits, rough_bits, roof, share((left_words, left_pairs))), _KEYED_DDL))
    words = cut(by_key(second, _sums(least, bits)))
    filters = share((_bitmap(words.select("key"), words.count()), left_pairs, *_rough_bitmaps(second.where("part >= 0"), least, rough_bits)))

    found = cut(by_key(docs.mapInArrow(_candidates(bits, filters), _KEYED_DDL), _seen(bits)).select("key", "count"))
    hot = _column(_most(found, SLOTS).select("key").toArrow(), "key")
    table = share(SlotTable(hot.view(np.uint64)))
    counted = cut(docs.mapInArrow(_by_slot(bits, filters, table), _KEYED_DDL))
    phrases = cut(by_key(counted, _sums(least, bits)).unionByName(_read_slots(_tree_sum(counted.where("part >= 0"), None), table, least)))
    counts = cut(phrases.unionByName(words))

    # what is read by slot now: frequent words and phrases, the most frequent ones if they are too many
    size = counts.count()
    kept = (_most(counts, SLOTS) if size > SLOTS else counts).toArrow()
    slots = SlotTable(_column(kept, "key").view(np.uint64))
    by_slot = np.zeros(len(slots), np.int64)
    by_slot[slots.find(_column(kept, "key").view(np.uint64))] = _column(kept, "count")
    owners = np.zeros(len(slots), np.int64)
    owners[slots.find(_column(kept, "key").view(np.uint64))] = _column(kept, "owner")
    marks = _bitmap(phrases.select(F.col("mark").alias("key")), size) if size > len(slots) else np.zeros(0, np.uint64)
    read = share((slots, by_slot))

    def cut_up(*wanted):
        spelled = cut(docs.mapInArrow(_spelled(filters, share(wanted)), "lang string, phrase string").distinct())
        return cut(spelled.mapInArrow(_cuts(read), "lang string, phrase string, k int, key long, left long, right long, a long, l long, r long"))

    cuts, left = cut_up(slots, owners, marks), None
    while True:
        missing = cut(phrases.select("key").join(cuts.select("key"), "key", "left_anti"))
        before, left = left, missing.count()
        if not left:
            break
        if left == before:
            raise RuntimeError(f"{left} phrases were counted but aren't found again")
        # the texts were dealt to other tasks than when they were counted: whoever has these phrases tells them
        late = SlotTable(_column(missing.limit(SLOTS).toArrow(), "key").view(np.uint64))
        cuts = cuts.unionByName(cut_up(late, None, np.zeros(0, np.uint64)))
    if size > len(slots):
        known = cuts.where("a is not null and l is not null and r is not null")
        cuts = known.unionByName(_with_counts(cuts.where("a is null or l is null or r is null"), counts))
    cuts = cuts.where(F.col("a") >= least)

    scored = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    whole = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    whole = cut(whole.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    w = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    inner = whole.where(F.size(w) > 2).select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("longer"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, k: F.col(c).cast("decimal(20,0)") * F.lit(k).cast("decimal(3,0)")
    free = whole.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", 80)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    early = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _rough_bitmaps(arrays: DataFrame, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For both halves of the sum of arrays, the places whose rough count reaches the least count; the bitmaps are of bounded size."""
    roof, out = min(255, least), np.zeros((2 << bits) // 8, np.uint8)

    def run(batches):
        for batch in batches:
            for bucket, size, blob in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(_decoded(blob, size) >= roof, bitorder="little").tobytes()], pa.binary())], names=["bucket", "blob"])

    for r in _tree_sum(arrays, least).mapInArrow(run, "bucket int, blob binary").toLocalIterator():
        at = r["bucket"] * (BLOCK // 8)
        out[at : at + len(r["blob"])] = np.frombuffer(r["blob"], np.uint8)
    words = out.view(np.uint64)
    return words[: len(words) // 2], words[len(words) // 2 :]


def _read_slots(arrays: DataFrame, table, least: int) -> DataFrame:
    """The keys of slots whose counts reach the least count."""

    def run(batches):
        keys = table.value.keys
        for batch in batches:
            for bucket, size, blob, owner in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                counts = _decoded(blob, size)
                at = np.flatnonzero(counts >= least)
                yield _counted_rows(keys[bucket * BLOCK + at], counts[at], _decoded(owner, size)[at] - 1)

    return arrays.mapInArrow(run, _COUNTED_DDL)


def oracle_sql(least: int = 30, top: int = 2000) -> str:
    """The same by listing all phrases of every piece."""
    upper = LOWER.tobytes()[65:91].decode().upper()
    grams = lambda n: f"select lang, {n} as words, array_to_string(w[i:i + {n - 1}], ' ') as phrase, w from (select lang, w, unnest(range(1, len(w) - {n - 2})) as i from p)"
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return f"""
    with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as text from documents),
    s as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
    p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from s),
    g as ({' union all '.join(f'select lang, words, phrase from ({grams(n)})' for n in range(1, LONGEST + 1))}),
    f as (select lang, words, phrase, count(*)::bigint as a from g group by all having count(*) >= {least}),
    total as (select lang, sum(len(w))::bigint as n from p group by lang),
    c as (select lang, phrase, words, a, string_split(phrase, ' ') as w from f where words > 1),
    x as (select lang, phrase, words, a, w, unnest(range(1, words)) as k from c),
    y as (select x.lang, x.phrase, x.k, x.a, one.a as l, two.a as r, (2000000::hugeint * x.a // (one.a::hugeint + two.a))::bigint as score from x join f one on one.lang = x.lang and one.phrase = {part(1, 'x.k')} join f two on two.lang = x.lang and two.phrase = {part('x.k + 1', 'x.words')}),
    z as (select lang, phrase, a, l, r, score from y qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from (select lang, w, a, m, unnest(range(1, words - m + 2)) as i from (select *, unnest(range(2, words)) as m from c)) group by all),
    free as (select z.* from z left join inside using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a)
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from free join total using (lang) qualify rank <= {top}"""
