"""Join of two columns of names by edit distance, on pigeonhole segments.

A name is cut into 2 * most + 1 pieces. Each of at most `most` edits changes one
piece, an exchange of neighbours that straddles a border two, so one piece at least
stays as it is and the other name holds it, shifted by no more than the lengths
and the edits allow. Pieces are joined on (length, number of the piece, its
characters); pairs that meet are verified. Names too short for so many pieces are
joined on what they have in common after deletions.

The distance is the unrestricted one of Damerau and Levenshtein over code points:
insertions, deletions, substitutions, and exchanges of neighbours, also of such that
become neighbours only by deletions, or stop being so by insertions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the distance tables that a task holds at a time.
CELLS = 1 << 22
FAR = 1 << 14


def _points(names: list[str], width: int, blank: int) -> np.ndarray:
    """Code points as rows of a table; blank beyond a name's end."""
    table = np.full((width, len(names)), blank, np.int32)
    for k, name in enumerate(names):
        table[: len(name), k] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.int32)
    return table


def distances(one: list[str], two: list[str], most: int) -> np.ndarray:
    """The distance of each pair, most + 1 for any that is larger; the pairs are columns of one banded table."""
    la, lb = (np.array([len(x) for x in names], np.int64) for names in (one, two))
    rows, columns, band = int(la.max(initial=0)), int(lb.max(initial=0)), 2 * most + 1
    a, b = _points(one, rows, -1), _points(two, columns, -2)
    # d[i, j - i + most] is the distance of the first i and the first j characters
    d = np.full((rows + 1, band, len(one)), FAR, np.int16)
    d[0, most:] = np.arange(most + 1, dtype=np.int16)[:, None]
    for i in range(rows + 1):
        for j in range(max(0, i - most), min(columns, i + most) + 1):
            k = j - i + most
            if i == 0:
                continue
            best = np.full(len(one), FAR, np.int16) if j else np.full(len(one), i, np.int16)
            if j:
                best = d[i - 1, k] + (a[i - 1] != b[j - 1])
                if k:
                    best = np.minimum(best, d[i, k - 1] + 1)
            if k + 1 < band:
                best = np.minimum(best, d[i - 1, k + 1] + 1)
            # a[x] .. a[i] became b[y] .. b[j] by an exchange of the ends, and what lies between by deletion and insertion
            for x in range(max(1, i - most), i):
                for y in range(max(1, j - most + (i - x - 1)), j):
                    cost = (i - x - 1) + 1 + (j - y - 1)
                    at = (y - 1) - (x - 1) + most
                    if cost <= most and 0 <= at < band:
                        swapped = (a[x - 1] == b[j - 1]) & (a[i - 1] == b[y - 1])
                        best = np.where(swapped, np.minimum(best, d[x - 1, at] + cost), best)
            d[i, k] = best
    end = lb - la + most
    inside = (end >= 0) & (end < band)
    found = d[la, np.clip(end, 0, band - 1), np.arange(len(one))]
    return np.minimum(np.where(inside, found, most + 1), most + 1)


_PAIRS = pa.schema([("query", pa.string()), ("name", pa.string()), ("distance", pa.int32())])


def _verified(most: int):
    def run(batches):
        for batch in batches:
            queries, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(queries)), key=lambda k: max(len(queries[k]), len(names[k])))
            while order:
                longest = max(len(queries[order[0]]), len(names[order[0]])) + 1
                part = order[: max(1, CELLS // (longest * (2 * most + 1)))]
                part = [k for k in part if max(len(queries[k]), len(names[k])) < 2 * longest]
                order = order[len(part) :]
                found = distances([queries[k] for k in part], [names[k] for k in part], most)
                kept = [(k, f) for k, f in zip(part, found.tolist()) if f <= most]
                yield pa.RecordBatch.from_arrays([pa.array([queries[k] for k, _ in kept], pa.string()), pa.array([names[k] for k, _ in kept], pa.string()), pa.array([f for _, f in kept], pa.int32())], schema=_PAIRS)

    return run


def _starts(length: Column, piece: int, pieces: int) -> tuple[Column, Column]:
    """Where a piece begins (from 0), and its length."""
    begin = F.floor(length * piece / pieces).cast("int")
    return begin, F.floor(length * (piece + 1) / pieces).cast("int") - begin


def _key(length: Column, piece: int, part: Column) -> Column:
    return F.struct(length.alias("length"), F.lit(piece).alias("piece"), part.alias("part"))


def _own_pieces(most: int) -> Column:
    pieces, name = 2 * most + 1, F.col("name")
    length, keys = F.length(name), []
    for p in range(pieces):
        begin, size = _starts(length, p, pieces)
        keys.append(_key(length, p, F.substr(name, begin + 1, size)))
    return F.array(*keys)


def _shifted_parts(most: int) -> Column:
    """What a partner's pieces can be: for each length of the partner and each shift that `most` edits allow, the characters there."""
    pieces, name, keys = 2 * most + 1, F.col("name"), []
    for longer in range(-most, most + 1):
        length = F.length(name) - longer
        for p in range(pieces):
            begin, size = _starts(length, p, pieces)
            for shift in range(-most, most + 1):
                if abs(shift) + abs(longer - shift) <= most:
                    fits = (length >= pieces) & (begin + shift >= 0) & (begin + shift + size <= F.length(name))
                    keys.append(F.when(fits, _key(length, p, F.substr(name, begin + shift + 1, size))))
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def _deleted(most: int) -> Column:
    """The name without any `most` or fewer of its characters."""
    without = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))
    held = F.array(F.col("name"))
    for _ in range(most):
        held = F.array_distinct(F.concat(held, F.flatten(F.transform(held, without))))
    return held


def similar_names(queries: DataFrame, names: DataFrame, most: int = 1) -> DataFrame:
    """(query, name, distance): all pairs of distinct values of the two tables' columns `name` at a distance of `most` or less.

    Queries are the side that is cut into pieces. Null and empty names pair with
    nothing; repeated rows count once; other columns are ignored. A table without
    rows gives no pairs. Names of any length are compared whole.
    """
    q, n = (t.select("name").where("name is not null and name <> ''").distinct() for t in (queries, names))
    pieces, size = 2 * most + 1, F.length("name")
    near = F.levenshtein("query", "name", 2 * most) >= 0  # an exchange is two of its edits
    long = q.where(size >= pieces).select(F.col("name").alias("query"), F.explode(_own_pieces(most)).alias("key")).select("query", "key.*")
    parts = n.where(size >= pieces - most).select("name", F.explode(_shifted_parts(most)).alias("key")).select("name", "key.*")
    # both sides grow with the input, so neither may be broadcast, however small it is now
    met = long.hint("merge").join(parts, ["length", "piece", "part"]).where(near).select("query", "name")
    short = q.where(size < pieces).select(F.col("name").alias("query"), F.explode(_deleted(most)).alias("part"))
    rest = n.where(size < pieces + most).select("name", F.explode(_deleted(most)).alias("part"))
    met = met.unionByName(short.hint("merge").join(rest, "part").where(near).select("query", "name"))
    return met.distinct().mapInArrow(_verified(most), "query string, name string, distance int")


def misspelt(name: Column, key: Column) -> Column:
    """name with two neighbours exchanged where the key's checksum is even: at its remainder by the number of neighbours."""
    h, length = F.crc32(key.cast("string").cast("binary")), F.length(name)
    at = F.pmod(h, F.greatest(length - 1, F.lit(1)).cast("long")).cast("int")
    moved = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2, F.lit(1)), F.substr(name, at + 1, F.lit(1)), F.substr(name, at + 3))
    return F.when((h % 2 == 0) & (length >= 2), moved).otherwise(name)


def match_names(clients: DataFrame, vendors: DataFrame, most: int = 1) -> DataFrame:
    """Per vendor and exact distance of `most` or less: vendor_id, distance, n_clients, first_client_id, clients_crc.

    clients(client_id, name) are summed up by name before they are joined, so however
    many share one they are one row; each client row counts, repeated ones too, while
    a null client_id adds to n_clients only. vendors(vendor_id, name) are misspelt as
    misspelt() says, with a null vendor_id not at all; equal vendor rows count once,
    and a vendor with several names sums over them. Null and empty names take no
    part. Other columns are ignored.
    """
    held = clients.where("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.coalesce(F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))), F.lit(0)).alias("crc"))
    sought = vendors.select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("name")).where("name is not null and name <> ''").distinct()
    pairs = similar_names(sought, held, most)
    found = pairs.hint("merge").join(held, "name").groupBy("query", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    per = sought.hint("merge").join(found, sought.name == found.query).groupBy("vendor_id", "distance")
    return per.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))


def oracle_sql() -> str:
    """match_names() with a distance of 1 at most, by comparing each name with each."""
    step = "list_reduce([xor({c}, {b})]::bigint[] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = lambda v: f"xor(4294967295::bigint, list_reduce([4294967295]::bigint[] || list_transform(string_split({v}::varchar, ''), lambda s: ascii(s)::bigint), lambda c, b: {step.format(c='c', b='b')}))"
    mismatch = "list_filter(range(1, length(v.name) + 1), lambda i: substring(v.name, i::bigint, 1) <> substring(c.name, i::bigint, 1))"
    shorter, longer = "(case when length(v.name) < length(c.name) then v.name else c.name end)", "(case when length(v.name) < length(c.name) then c.name else v.name end)"
    return f"""
    with held as (select name, count(*) as n, min(client_id) as first, sum({crc('client_id')}) as crc from clients where name <> '' group by name),
    h as (select vendor_id, name, {crc('vendor_id')} as h, length(name) as len from vendors),
    v as (select distinct vendor_id, case when h % 2 = 0 and len >= 2 then substring(name, 1, h % (len - 1)) || substring(name, h % (len - 1) + 2, 1) || substring(name, h % (len - 1) + 1, 1) || substring(name, h % (len - 1) + 3) else name end as name from h where name <> ''),
    met as (select v.vendor_id, v.name as vn, c.name as cn, c.n, c.first, c.crc, case when length(v.name) = length(c.name) then {mismatch} end as off,
        case when length(v.name) <> length(c.name) then len(list_filter(range(1, length({longer}) + 1), lambda i: substring({longer}, 1, i::bigint - 1) || substring({longer}, i::bigint + 1) = {shorter})) > 0 end as cut
        from v join held c on abs(length(v.name) - length(c.name)) <= 1),
    far as (select *, case when len(off) = 0 then 0 when len(off) = 1 or cut or (len(off) = 2 and off[2] = off[1] + 1 and substring(vn, off[1], 1) = substring(cn, off[2], 1) and substring(vn, off[2], 1) = substring(cn, off[1], 1)) then 1 end as distance from met)
    select vendor_id, distance::int as distance, sum(n)::bigint as n_clients, min(first) as first_client_id, sum(crc)::bigint as clients_crc from far where distance is not null group by vendor_id, distance"""
