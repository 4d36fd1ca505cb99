"""URL filters on a sorted array of 64-bit digests.

Rules and list entries are keys `host/path`. Their xxhash64 digests are one sorted
array, kept as files that workers map into memory; a URL's possible keys (each
suffix of its host, with each path length that any key has) are probed together by
vectorised binary search, and a digest that is found is confirmed by the stored
string, so a collision can't decide.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): a host and a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Hosts to block where no rule fits, in the same form with an empty path.
BLOCKED = ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "casino-win.example.org", "free-bets.example.org", "cheap-pills.example.org", "casino-win.example.net", "free-bets.example.net", "cheap-pills.example.net")
#: Largest packed list that is sent to workers as one block.
BLOCK_BYTES = 32 << 20


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def pack_keys(keys: list[tuple[str, int]], hash_=digest) -> list[bytes]:
    """(key, value) pairs as blocks of: count, sorted digests, values, string offsets, strings."""
    found = sorted((hash_(k.encode()), k.encode(), v) for k, v in dict(keys).items())
    blocks, at = [], 0
    while at < len(found) or not blocks:
        stop, size = at, 0
        while stop < len(found) and (stop == at or size + len(found[stop][1]) + 24 <= BLOCK_BYTES):
            size += len(found[stop][1]) + 24
            stop += 1
        part = found[at:stop]
        offsets = np.cumsum([0, *(len(k) for _, k, _ in part)])
        blocks.append(b"".join([np.int64(len(part)).tobytes(), np.array([d for d, _, _ in part], np.uint64).tobytes(), np.array([v for _, _, v in part], np.int64).tobytes(), offsets.astype(np.int64).tobytes(), *(k for _, k, _ in part)]))
        at = stop
    return blocks


class Digests:
    """A block, mapped from a file of this worker that is unlinked at once."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self._map, np.int64, 1)[0])
        self.digests = np.frombuffer(self._map, np.uint64, n, 8)
        self.values = np.frombuffer(self._map, np.int64, n, 8 + 8 * n)
        self.offsets = np.frombuffer(self._map, np.int64, n + 1, 8 + 16 * n)
        self.strings = 16 + 24 * n

    def find(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests):
            return out
        at = np.searchsorted(self.digests, hashes)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == hashes)
        for i in hit.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == hashes[i]:  # equal digests: compare the strings
                if self._map[self.strings + int(self.offsets[k]) : self.strings + int(self.offsets[k + 1])] == keys[i]:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((p for p in (rest.find(c) for c in "/?#") if p >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((p for p in (rest.find(c) for c in "?#") if p >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:end]


SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def _judge(blocks, verdicts: list[str], names: list[str], lengths: list[int], labels: int, hash_):
    """blocks: a broadcast of packed blocks; values below len(names) are rules, others list entries."""

    def run(batches):
        held = [Digests(b) for b in blocks.value]
        for batch in batches:
            ids = batch.column(0)
            for first in range(0, len(batch), 4096):
                urls = batch.column(1).slice(first, 4096).to_pylist()
                keys, owner, cols = [], [], ([], [], [], [])
                for i, url in enumerate(urls):
                    host, path = split_url(url)
                    cols[0].append(host)
                    cols[1].append(path)
                    ends = [path[:m].encode() for m in lengths if m <= len(path)]
                    # only suffixes of as many labels as a key can have; each begins after a dot or at the host's start
                    cut, starts = len(host), []
                    while host and len(starts) < labels:
                        cut = host.rfind(".", 0, cut)
                        starts.append(cut + 1)
                        if cut < 0:
                            break
                    for s in starts:
                        suffix = host[s:].encode()
                        keys += [suffix + e for e in ends]
                        owner += [i] * len(ends)
                hashes = np.array([hash_(k) for k in keys], np.uint64)
                found = np.full(len(keys), -1, np.int64)
                for h in held:
                    found = np.maximum(found, h.find(keys, hashes))
                best, listed = {}, set()
                for j in np.flatnonzero(found >= 0).tolist():
                    if found[j] < len(names):
                        if len(names[found[j]]) > len(names[best[owner[j]]] if owner[j] in best else ""):
                            best[owner[j]] = int(found[j])
                    else:
                        listed.add(owner[j])
                for i in range(len(urls)):
                    cols[2].append(names[best[i]] if i in best else None)
                    cols[3].append(verdicts[best[i]] if i in best else "block" if i in listed else "allow")
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(urls)), *(pa.array(c, pa.string()) for c in cols)], schema=SCHEMA)

    return run


def filter_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, id_col: str = "page_id", url_col: str = "url", hash_=digest) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict (allow or block).

    Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from
    there up to ?, # or the end; a null url, or one without ://, has neither. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest
    decides. Without a rule, a host is blocked if it or a parent is in `blocked`,
    else allowed. Repeated rows each have a row; ids may be null. No other column is read.
    """
    names = [r for _, r in rules]
    keys = [(b.lower(), len(names)) for b in blocked] + [(r, k) for k, (_, r) in enumerate(rules)]
    parts = [(k.partition("/")[0], k[len(k.partition("/")[0]) :]) for k, _ in keys]
    lengths, labels = sorted({len(p) for _, p in parts}), max((h.count(".") + 1 for h, _ in parts), default=0)
    # each packed block is at most BLOCK_BYTES; workers map them, so they aren't held in memory
    blocks = pages.sparkSession.sparkContext.broadcast(pack_keys(keys, hash_))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return named.mapInArrow(_judge(blocks, [v for v, _ in rules], names, lengths, labels, hash_), "page_id long, host string, path string, rule string, verdict string")


def oracle_sql(rules=RULES, blocked=BLOCKED) -> str:
    table = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{r[len(r.partition('/')[0]):]}')" for v, r in rules)
    hosts = ", ".join(f"('{b}')" for b in blocked)
    return f"""
with u as (select row_number() over () rid, page_id, coalesce(url, '') url from pages),
h as (select *, case when contains(url, '://') then regexp_extract(url[strpos(url, '://') + 3 :], '^[^/?#]*') else '' end raw from u),
p as (select rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, case when contains(url, '://') then regexp_extract(url[strpos(url, '://') + 3 + length(raw) :], '^[^?#]*') else '' end path from h),
r(v, rule, rh, rp) as (values {table}), b(bh) as (values {hosts}),
j as (select rid, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) v from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
k as (select distinct rid from p join b on host = bh or ends_with(host, '.' || bh))
select page_id, host, path, rule, coalesce(v, case when k.rid is not null then 'block' else 'allow' end) verdict from p left join j using (rid) left join k using (rid)"""
