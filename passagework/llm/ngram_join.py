"""Exact Jaccard self-join of documents on word n-gram sets, with set-relation skipping.

Two relations between sets save work, neither loses a link:

* Index level. Every set puts its first tokens, in one global order (hash order,
  very frequent tokens last), into an inverted index; pairs at the threshold share
  at least min(l_a, l_b) of them. A token of the prefix that no other prefix holds
  can't be common to a pair that meets later in the order, so an entry's position,
  less the shared entries before it, bounds what the set can still have in common
  with anyone, and hence the sizes of partners it can reach. Entries that reach
  nobody leave the lists, and a list is only walked over the block of sizes that
  both sides reach, before a pair is made.
* Answer level. In each list the set whose tokens are the most frequent leads sets of
  its size; every set is compared with the leader most of its lists agree on, and
  the difference of the two is kept. For two sets of one leader X the overlap
  follows from those with X: |Y n Z| = |X| - gone(Y) - gone(Z) + |D(Y) n D(Z)| for
  the differences D. So their answers are derived from the leader's: a prefix index
  over the short differences finds the pairs that reach the threshold, and sets that
  are in one component through the leader are never compared. Only pairs of different
  leaders are taken from the lists.

Sets are 64-bit hashes of n-grams; equal sets are one node from the start, so
exact copies cost one entry for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.blobs import BLOB_ARROW, BLOB_SCHEMA, bits_for, cut, files_for, pack, text_bytes, tidy, unpack
from passagework.llm.components import components
from passagework.llm.words import BLANK, set_node, shingle_sets, slabs

#: Tokens in more sets than this go to the end of the order, the most frequent MOST_HEAVY of them.
HEAVY, MOST_HEAVY = 128, 1 << 18
#: Percentage of similarity from which a set belongs to its leader's group.
MEMBER = 50
#: Entries of a list that one task walks at once; longer lists are dealt out as pairs of blocks.
BLOCK = 1 << 14
#: Entries of lists, and pairs, that a task handles at a time.
WALK = 1 << 17
#: Entries gathered in a task before they are packed and sent.
FLUSH = 1 << 18
#: Bits of the filter that chooses texts to read again: eight for each set, within these powers of two.
LEAST_BLOOM, MOST_BLOOM = 20, 27


def prefix_length(n: np.ndarray | int, percent: int) -> tuple:
    """Entries a set of n tokens puts into the index, and the common ones asked for (l)."""
    more = 1 + n // 50
    return np.minimum(n, n - -(-percent * n // 100) + more), more


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted=None) -> Iterator[tuple]:
    """(ids, first columns of the rows, their sorted sets) by slab."""
    for batch in batches:
        keep = None
        if wanted is not None:
            keep = wanted(batch.column(0))
            batch = batch.filter(pa.array(keep))
        for slab in slabs(batch.column(1), BLANK, lower=True):
            yield batch.column(0).slice(slab.first, slab.stop - slab.first), shingle_sets(slab, n)


def _meta(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for ids, sets in _sets(batches, n):
            nodes = [set_node(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], schema=schema)

    return run


def _counted(n: int, bits: int):
    """Blobs of (token, number of sets in this task)."""

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from pack(tokens, [np.minimum(counts, 65535).astype("<u2")], bits)

        for _, sets in _sets(batches, n):
            for s in sets:
                if len(s) and (node := set_node(s)) not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(held[-1])
            if size >= 2 * FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _heavy(bits: int):
    schema = pa.schema([("token", pa.int64()), ("df", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        key, count = unpack(table.column("blob").to_pylist(), ["<u2"])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(count, first)
        keep = total > HEAVY
        token = (np.int64(table.column("bucket")[0].as_py()) << 32) + key[first][keep].astype(np.int64)
        return pa.Table.from_arrays([pa.array(token), pa.array(total[keep])], schema=schema)

    return run


def _postings(n: int, percent: int, bits: int, heavy):
    def run(batches):
        held, size, seen, demoted = [], 0, set(), heavy.value

        def flush():
            yield from pack(np.concatenate([h[0] for h in held]), [np.concatenate([h[k] for h in held]) for k in (1, 2)], bits)

        for _, sets in _sets(batches, n):
            for s in sets:
                if not len(s) or (node := set_node(s)) in seen:
                    continue
                seen.add(node)
                p = int(prefix_length(len(s), percent)[0])
                if len(demoted):
                    short = (s >> np.uint64(32 - bits)).astype(np.int64)
                    at = np.minimum(np.searchsorted(demoted, short), len(demoted) - 1)
                    last = demoted[at] == short
                    if last.any():
                        s = np.concatenate([s[~last], s[last]])
                s = s[:p]
                held.append((s, np.full(len(s), node, "<i8"), np.minimum(np.arange(len(s)), 65535).astype("<u2")))
                size += len(s)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _lists(bits: int):
    """A bucket's lists of two sets or more: (token, node, pos, length of the list)."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("pos", pa.int32()), ("length", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        key, node, pos = unpack(table.column("blob").to_pylist(), ["<i8", "<u2"])
        order = np.lexsort((pos, node, key))
        key, node, pos = key[order], node[order], pos[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (pos[1:] != pos[:-1])] if len(key) else np.zeros(0, bool)
        key, node, pos = key[new], node[new], pos[new]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.r_[head, len(key)])
        each = np.repeat(length, length)
        many = each > 1
        token = (np.int64(table.column("bucket")[0].as_py()) << 32) + key.astype(np.int64)
        return pa.Table.from_arrays([pa.array(token[many]), pa.array(node[many]), pa.array(pos[many].astype(np.int32)), pa.array(each[many].astype(np.int32))], schema=schema)

    return run


def _entries(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """List entries that can belong to a pair, with the largest partner they reach, and how far their set is from others' tokens ("bad")."""
    mine = Window.partitionBy("node")
    least, prefix = f"(({percent} * n + 99) div 100)", f"least(n, n - ({percent} * n + 99) div 100 + 1 + n div 50)"
    known = lists.join(sizes, "node").withColumn("rank", F.row_number().over(mine.orderBy("pos", "token")) - 1)
    known = known.withColumn("shared", F.count("*").over(mine)).withColumn("rare", F.sum(F.expr("1048576 div length")).over(mine))
    known = known.withColumn("most", F.expr("n - greatest(0, pos - rank)")).withColumn("reach", F.expr(f"most * {100 + percent} div {percent} - n"))
    known = known.where(F.expr(f"reach >= {least} and shared >= 1 + {least} div 50"))
    return known.select("token", "node", "pos", "n", "reach", F.expr(f"(rare + 1048576L * ({prefix} - shared)) div {prefix}").alias("bad"), "length")


def _stars(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set a with the leader b that a quarter or more of its lists have, the least bad one.

    Leaders are found among sets of similar size; the size classes of even and odd
    tokens are shifted by half a class, so that no group lies on a border in all lists.
    """
    step = float(np.log(100 / min(percent, 90)))
    classed = entries.select("token", "node", "bad", F.floor(F.log("n") / step + F.expr("0.5 * (token & 1)")).alias("class"))
    heads = classed.groupBy("token", "class").agg(F.min(F.struct("bad", "node")).alias("head"))
    votes = classed.join(heads, ["token", "class"]).where("head.node <> node").groupBy("node", F.col("head.node").alias("b"), F.col("head.bad").alias("bad")).agg(F.count("*").alias("c"))
    wanted = votes.withColumn("total", F.sum("c").over(Window.partitionBy("node"))).where("4 * c >= total")
    return wanted.groupBy(F.col("node").alias("a")).agg(F.min(F.struct("bad", "b")).alias("head")).select("a", F.col("head.b").alias("b"))


def _cross(percent: int):
    """Pairs of different components and leaders of each list; rows come ordered by unit (a list, or two blocks of one) and size.

    The most numerous group of a list doesn't look for partners, the others do; so
    a list that near copies fill costs what the rest of it needs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pos_a", pa.int32()), ("pos_b", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64())])

    def run(batches):
        rest, size = [], 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            rest.append(cols)
            size += len(cols[0])
            if size < WALK:
                continue
            cols = [np.concatenate(x) for x in zip(*rest)]
            last = int(np.searchsorted(-(cols[0][::-1] == cols[0][-1]).astype(np.int8), 0))  # rows of the last unit, which may go on
            yield from pairs(*[c[: size - last] for c in cols])
            rest, size = [[c[size - last :] for c in cols]], last
        if rest:
            yield from pairs(*[np.concatenate(x) for x in zip(*rest)])

    def pairs(unit, node, pos, comp, team, n, reach, side):
        if not len(node):
            return
        head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        which = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(unit)]))
        # the most numerous team of each unit
        names, team = np.unique(team, return_inverse=True)
        group = which * len(names) + team
        _, at, count = np.unique(group, return_inverse=True, return_counts=True)
        count = count[at]
        most = np.maximum.reduceat(count, head)[which]
        main = group == np.minimum.reduceat(np.where(count == most, group, np.iinfo(np.int64).max), head)[which]
        # sizes ascend in a unit: partners are a block from the smallest size that can reach the threshold to the largest in reach
        base = which * (int(max(n.max(), reach.max())) + 2)
        seeks = np.flatnonzero(~main)
        begin = np.searchsorted(base + n, (base - (-percent * n // 100))[seeks], "left")
        stop = np.searchsorted(base + n, (base + reach)[seeks], "right")
        width = np.maximum(stop - begin, 0)
        edges = np.unique(np.r_[0, np.searchsorted(np.cumsum(width), np.arange(WALK, int(width.sum()) + WALK, WALK)), len(seeks)])
        for lo, hi in zip(edges[:-1], edges[1:]):
            w = width[lo:hi]
            left = np.repeat(seeks[lo:hi], w)
            right = np.repeat(begin[lo:hi] - (np.cumsum(w) - w), w) + np.arange(len(left))
            keep = (comp[left] != comp[right]) & (team[left] != team[right]) & (n[left] <= reach[right])
            keep &= (main[right] | (left < right)) & ((side[left] < 0) | (side[left] != side[right]))
            left, right = left[keep], right[keep]
            swap = node[left] > node[right]
            a, b = np.where(swap, right, left), np.where(swap, left, right)
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[x], node[y], pos[x], pos[y], n[x], n[y])], schema=schema)

    return run


def _between(entries: DataFrame, teams: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components and leaders that the lists and their positions leave."""
    placed = entries.join(teams, "node", "left").select("token", "node", "pos", F.coalesce("comp", "node").alias("comp"), F.coalesce("team", "node").alias("team"), "n", "reach", "length")
    blocks, block = F.expr(f"(length + {BLOCK - 1}) div {BLOCK}"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = placed.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("unit", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))).select("unit", "node", "pos", "comp", "team", "n", "reach", F.when(F.col("block") != F.col("other"), F.col("block")).otherwise(-1).alias("side"))
    ordered = dealt.repartition("unit").sortWithinPartitions("unit", "n", "node", "pos")
    common = ordered.mapInArrow(_cross(percent), "a long, b long, pos_a int, pos_b int, n_a long, n_b long")
    found = common.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("pos_a").alias("i"), F.max("pos_b").alias("j"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return found.where(f"c >= least(1 + n_a div 50, 1 + n_b div 50) and (100 + {percent}) * (c + greatest(0, least(n_a - i - 1, n_b - j - 1))) >= {percent} * (n_a + n_b)").select("a", "b")


def _read_sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, n: int, files: int) -> DataFrame:
    """(node, tokens) of these nodes, from their texts; some others that the filter lets through may be among them, and rows may repeat."""
    ids = cut(named.groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("key")).join(nodes, "node", "left_semi").select("key"), files)
    bits = max(LEAST_BLOOM, min(MOST_BLOOM, (8 * ids.count()).bit_length()))
    bit = F.col("key").bitwiseAND((1 << bits) - 1)
    words = ids.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {(1 << bits) - 1}) & 31 as int))")).alias("bits")).toPandas()
    bloom = np.zeros(1 << (bits - 5), np.uint32)
    bloom[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(bloom)
    return cut(docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_fetch(n, held, bits), "node long, tokens binary"))


def _fetch(n: int, bloom, bits: int):
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def wanted(keys):
        at = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64((1 << bits) - 1)
        return (bloom.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0

    def run(batches):
        for _, sets in _sets(batches, n, wanted):
            sets = [s for s in sets if len(s)]
            for k in range(0, len(sets), 256):
                part = sets[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array([set_node(s) for s in part], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in part], pa.binary())], schema=schema)

    return run


_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_b", pa.int64()), ("gone", pa.int64()), ("added", pa.int64()), ("linked", pa.bool_()), ("diff", pa.list_(pa.int64()))])


def _compared(percent: int, member: int, with_diff: bool):
    """Pairs (a, b) of `member` percent or more, what b has and a hasn't, the reverse, and both together."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in _COMPARED]
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (2, 3))
                z = np.concatenate([x, y])
                z.sort()
                same = z[1:] == z[:-1]
                common = int(np.count_nonzero(same))
                if 100 * common < member * (len(z) - common):
                    continue
                alone = np.ones(len(z), bool)
                alone[1:] &= ~same
                alone[:-1] &= ~same
                row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(y), len(y) - common, len(x) - common, 100 * common >= percent * (len(z) - common), z[alone].view(np.int64) if with_diff else [])
                for held, v in zip(out, row):
                    held.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _COMPARED)], schema=_COMPARED)

    return run


def _compare(sets: DataFrame, pairs: DataFrame, percent: int, member: int, files: int, with_diff: bool = False) -> DataFrame:
    """One row for each pair (a, b) whose whole sets are similar enough; both joins read one exchange of the sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b").select("a", "b", "left", "right")
    return cut(both.mapInArrow(_compared(percent, member, with_diff), "a long, b long, n_b long, gone long, added long, linked boolean, diff array<long>").dropDuplicates(["a", "b"]), files)


def _derived(members: DataFrame, comps: DataFrame, percent: int, files: int) -> DataFrame:
    """Links (a, b) between sets of one leader, from their differences with it.

    For members Y and Z of X a link means (100 + percent) * |D(Y) n D(Z)| >= G(Y) + G(Z) - K with
    G = 100 * gone + percent * added and K = (100 - percent) * |X|; Y is linked with X if G(Y) <= K.
    Two of these are in one component already, so one of a pair isn't: it looks, with a long prefix of
    its difference, among all members' short prefixes. Rare tokens of the group come first.
    """
    whole = 100 + percent
    with_others = members.join(members.where("not linked").select("b").distinct(), "b", "left_semi")
    rated = with_others.select("a", "b", "linked", "diff", F.size("diff").alias("d"), F.expr(f"100 * gone + {percent} * added").alias("g"), F.expr(f"{100 - percent} * n_b").alias("k"))
    rated = rated.join(comps.withColumnRenamed("node", "a"), "a", "left").select("a", "b", "linked", "diff", "d", "g", "k", F.coalesce("root", "a").alias("comp"))
    tokens = rated.select("a", "b", "linked", "d", "g", "k", "comp", F.explode("diff").alias("token"))
    often = tokens.groupBy("b", "token").agg(F.count("*").alias("df"))
    placed = tokens.join(often, ["b", "token"]).withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("df", "token")) - 1).where("df > 1")
    short = placed.where(f"i < d - g div {whole}").select("b", "token", F.col("a").alias("z"), F.col("d").alias("d_z"), F.col("g").alias("g_z"), F.col("i").alias("j"), F.col("comp").alias("comp_z"))
    long = placed.where(f"not linked and i <= d - greatest(1, (g - k + {whole - 1}) div {whole})").select("b", "token", F.col("a").alias("y"), "d", "g", "k", "i", "comp")
    need = f"greatest(1, (g + g_z - k + {whole - 1}) div {whole})"
    met = long.join(short, ["b", "token"]).where(f"y <> z and comp <> comp_z and d - i >= {need} and d_z - j >= {need}")
    pairs = met.select(F.least("y", "z").alias("y"), F.greatest("y", "z").alias("z")).distinct()
    one, two = rated.select(F.col("a").alias("y"), "diff", "g", "k"), rated.select(F.col("a").alias("z"), F.col("diff").alias("diff_z"), F.col("g").alias("g_z"))
    return cut(pairs.join(one, "y").join(two, "z").where(f"{whole} * size(array_intersect(diff, diff_z)) >= g + g_z - k").select(F.col("y").alias("a"), F.col("z").alias("b")), files)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id linked with it, itself included).

    Texts are lower-cased (A-Z) and split at ASCII white space. Documents link when
    100 * |A n B| >= percent * |A u B| over their sets of distinct n-word shingles;
    fewer than n words are one shingle. Null, empty and blank texts have no shingles
    and their own id as component. Repeated rows each have a row and share a
    component; rows with a null id link others, and get the smallest id linked with
    them, if any is not null. Ids are integers. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = text_bytes(docs, "text")
    spark, bits, files = docs.sparkSession, bits_for(total), files_for(total)
    meta = cut(docs.mapInArrow(_meta(n), "doc_id long, node long, n long"))
    named = meta.where("node is not null")

    counted = docs.mapInArrow(_counted(n, bits), BLOB_SCHEMA).groupBy("bucket").applyInArrow(_heavy(bits), "token long, df long")
    with tidy(spark):
        heavy = np.sort(counted.orderBy(F.desc("df"), "token").limit(MOST_HEAVY).toPandas()["token"].to_numpy(np.int64))
    index = docs.mapInArrow(_postings(n, percent, bits, spark.sparkContext.broadcast(heavy)), BLOB_SCHEMA)
    lists = cut(index.groupBy("bucket").applyInArrow(_lists(bits), "token long, node long, pos int, length int"), files)

    entries = cut(_entries(lists, named.groupBy("node").agg(F.first("n").alias("n")), percent), files)
    sets = _read_sets(docs, named, entries.select("node").distinct(), n, files)
    members = _compare(sets, cut(_stars(entries, percent), files), percent, min(MEMBER, percent), files, True)
    near = members.where("linked").select("a", "b")
    # two steps up the leaders name a part of a component; what that leaves apart is found as a link again
    up = near.select(F.col("a").alias("b"), F.col("b").alias("above"))
    roots = near.join(up, "b", "left").select(F.col("a").alias("node"), F.coalesce("above", "b").alias("root"))
    comps = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").join(up, F.col("node") == F.col("b"), "left_anti").distinct()), files)
    derived = _derived(members, comps, percent, files)

    teams = members.select(F.col("a").alias("node"), F.col("b").alias("team"))
    teams = comps.select("node", F.col("root").alias("comp")).join(teams, "node", "full").select("node", "comp", F.coalesce("team", "node").alias("team"))
    between = _compare(sets, cut(_between(entries, teams, percent), files), percent, percent, files).select("a", "b")

    groups = components(near.unionByName(derived).unionByName(between), files)
    first = named.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = first.join(groups, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named_groups = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return meta.join(named_groups, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
