"""MinHash near-duplicate groups by an LSH forest.

Each distinct shingle set has one signature of TREES * STEP minimum hashes. A tree
is the order of all sets by that signature, read in a circle from the tree's own
place on; sets that are next to each other there share a prefix, and the longer it is
the more similar they are. A tree isn't stored as an order: sets with a common prefix
of the present depth are a region, and a region of more than LEAF sets is looked at
again with a longer prefix, others stay. So the depth follows the density of each
region, and what a set is compared with are those neighbours whose common prefix is
the longest that keeps the region small.

In a region's leaf the signatures' low bytes estimate the similarity; what may reach
the threshold is joined to loose clusters, and links are confirmed on the whole sets:
in one task for a small cluster, by the exact set join for a large one. Deep regions
lose pairs; a set whose depths leave a larger chance than MISS of losing a partner at
the threshold goes through the exact join as well, with its cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import ngram_join
from passagework.llm.blobs import cut, files_for, text_bytes
from passagework.llm.components import components
from passagework.llm.words import BLANK, set_node, shingle_sets, slabs

#: Sorted orders, and the hashes between the beginnings of two of them.
TREES, STEP = 20, 6
HASHES = TREES * STEP
#: Common prefixes that are tried, one after the other, where a region is too dense.
DEPTHS = (2, 3, 5, 7, 10, 14, 20, 32, 56, HASHES)
#: Most sets of a leaf.
LEAF = 256
#: Standard deviations below the threshold at which an estimate still counts as a possible link.
SLACK = 5.5
#: Chance of losing a partner from which a set is joined exactly.
MISS = 1e-6
#: Sets, and tokens of all of them, of a cluster whose links one task confirms.
SMALL_SETS, SMALL_TOKENS = 256, 1 << 20
#: Rows, and pairs, that a task handles at a time.
ROWS, PAIRS = 1 << 14, 1 << 15
#: Copies of a region's count, so that a dense region's rows meet it in several tasks.
SALT = 16

_FACTORS = np.random.default_rng(12).integers(1 << 62, (1 << 64) - 1, HASHES, np.uint64, True) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes (32 bits) of sets that aren't empty, a row for each."""
    out = np.empty((len(sets), HASHES), ">u4")
    at = 0
    while at < len(sets):  # about PAIRS tokens at a time stay in the processor's cache
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= PAIRS):
            size += len(sets[stop])
            stop += 1
        tokens = np.concatenate(sets[at:stop])
        first = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
        for k, factor in enumerate(_FACTORS):
            out[at:stop, k] = np.minimum.reduceat(tokens * factor, first) >> np.uint64(32)
        at = stop
    return out


def _described(n: int):
    """(doc_id, node, n, signature, its hashes' low bytes) of each row; the last two only with a node's first row in the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("low", pa.binary())])

    def run(batches):
        seen = set()
        for batch in batches:
            for slab in slabs(batch.column(1), BLANK, lower=True):
                sets = shingle_sets(slab, n)
                nodes = [set_node(s) if len(s) else None for s in sets]
                fresh = {}
                for k, node in enumerate(nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        fresh[k] = len(fresh)
                signed = signatures([sets[k] for k in fresh])
                low = (signed & 0xFF).astype(np.uint8)
                held = [[rows[fresh[k]].tobytes() if k in fresh else None for k in range(len(sets))] for rows in (signed, low)]
                ids = batch.column(0).slice(slab.first, slab.stop - slab.first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(h, pa.binary()) for h in held)], schema=schema)

    return run


def _whole_groups(batches, columns: int, most: int):
    """Columns of rows that come ordered by the first one, in parts of about `most` rows that end where a group ends."""
    rest, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        rest.append([batch.column(k) if pa.types.is_binary(batch.column(k).type) else batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)])
        size += len(batch)
        if size < most:
            continue
        joined = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*rest)]
        last = int(np.searchsorted(joined[0], joined[0][-1], "left"))
        if last:
            yield [c[:last] for c in joined]
        rest, size = [[c[last:] for c in joined]], size - last
    if rest:
        yield [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*rest)]


def _spanning(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of `count` things the least one that the pairs join it with."""
    least = np.arange(count)
    while len(left):
        m = np.minimum(least[left], least[right])
        before = least.copy()
        np.minimum.at(least, left, m)
        np.minimum.at(least, right, m)
        least = least[least]
        if np.array_equal(before, least):
            break
    return least


def _neighbours(percent: int):
    """(a, b) of a leaf's sets that may be similar, as few as join them; rows are (leaf, node, n, low bytes), by leaf and size."""
    share = percent / 100
    least = int(HASHES * (share - SLACK * math.sqrt(share * (1 - share) / HASHES)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for leaf, node, n, low in _whole_groups(batches, 4, ROWS):
            low = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(len(node), HASHES)
            # rows ascend by size in a leaf: partners are those after a row that aren't too large for it
            end = np.searchsorted(leaf, leaf, "right")
            width = end - np.arange(len(leaf)) - 1
            edges = np.unique(np.r_[0, np.searchsorted(np.cumsum(width), np.arange(PAIRS, int(width.sum()) + PAIRS, PAIRS)), len(leaf)])
            found = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                w = width[lo:hi]
                left = np.repeat(np.arange(lo, hi), w)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
                fits = 100 * n[left] >= percent * n[right]
                left, right = left[fits], right[fits]
                alike = np.count_nonzero(low[left] == low[right], axis=1) >= least
                found.append((left[alike], right[alike]))
            root = _spanning(len(leaf), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            joined = np.flatnonzero(root != np.arange(len(leaf)))
            yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], schema=schema)

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x n y| >= percent * |x u y| for sorted sets."""
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    z = np.concatenate([x, y])
    z.sort()
    common = int(np.count_nonzero(z[1:] == z[:-1]))
    return 100 * common >= percent * (len(z) - common)


def _confirmed(percent: int):
    """(node, least node of its group) of each cluster's sets by their links; rows are (cluster, node, tokens), by cluster."""
    schema = pa.schema([("node", pa.int64()), ("least", pa.int64())])

    def run(batches):
        for cluster, node, tokens in _whole_groups(batches, 3, SMALL_SETS):
            head = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
            for a, b in zip(head, np.r_[head[1:], len(cluster)]):
                # rows may repeat: a set is taken once
                names, first = np.unique(node[a:b], return_index=True)
                sets = [np.frombuffer(tokens[int(a + k)].as_buffer(), "<u8") for k in first]
                group = np.arange(len(names))
                for i in range(1, len(names)):
                    for j in range(i):
                        if group[i] != group[j] and linked(sets[i], sets[j], percent):
                            low, high = sorted((group[i], group[j]))
                            group[group == high] = low
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[group])], schema=schema)

    return run


def forest_edges(nodes: DataFrame, percent: int, files: int) -> tuple[DataFrame, DataFrame]:
    """((a, b) that may be similar, (node) of sets whose depths may have lost a partner) of nodes(node, n, signature, low).

    Both sides of these joins grow with the input, so none is left to be broadcast while it is small.
    """
    share = percent / 100
    lost = lambda depth: math.log(max(1 - share**depth, 1e-300))
    held = nodes
    active, edges, deeper = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")), [], []
    for depth in DEPTHS:
        circle = F.concat("signature", "signature")
        keyed = active.select("node", "tree", F.xxhash64("tree", F.substr(circle, F.col("tree") * (4 * STEP) + 1, F.lit(4 * depth))).alias("leaf"))
        keyed = cut(keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")), files)
        regions = cut(keyed.groupBy("leaf").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node") % (1 << 40)).alias("members")).where("size > 1"), files)
        # trees often have a leaf of the same members: one of them is enough
        leaves = regions.where(F.col("size") <= LEAF).groupBy("size", "members").agg(F.min("leaf").alias("leaf")).select("leaf")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        members = keyed.hint("merge").join(leaves.select("leaf", salts), ["leaf", "salt"]).select("leaf", "node")
        members = members.hint("merge").join(held.select("node", "n", "low"), "node").select("leaf", "node", "n", "low")
        ordered = members.repartition("leaf").sortWithinPartitions("leaf", "n", "node")
        edges.append(cut(ordered.mapInArrow(_neighbours(percent), "a long, b long"), files))
        dense = regions.where(F.col("size") > LEAF).select("leaf", salts)
        if not dense.limit(1).count():
            break
        crowded = keyed.hint("merge").join(dense, ["leaf", "salt"])
        if depth == HASHES:  # the same signature as a whole
            edges.append(crowded.join(crowded.groupBy("leaf").agg(F.min("node").alias("b")).select("leaf", "b", salts), ["leaf", "salt"]).select(F.col("node").alias("a"), "b").where("a <> b"))
            break
        crowded = cut(crowded.select("node", "tree"), files)
        deeper.append(crowded.select("node", F.lit(lost(DEPTHS[DEPTHS.index(depth) + 1]) - lost(depth)).alias("more")))
        # later rounds only read the sets of dense regions
        held = cut(held.hint("merge").join(crowded.select("node").distinct(), "node", "left_semi"), files)
        active = crowded.hint("merge").join(held.select("node", "signature"), "node")
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    if not deeper:
        return found, nodes.select("node").limit(0)
    more = deeper[0]
    for d in deeper[1:]:
        more = more.unionByName(d)
    unsure = more.groupBy("node").agg(F.sum("more").alias("more")).where(F.col("more") + TREES * lost(DEPTHS[0]) > math.log(MISS)).select("node")
    return found, unsure


def _named_texts(n: int, bloom, bits: int):
    """(node, text) of the rows that the filter lets through."""
    schema = pa.schema([("node", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64((1 << bits) - 1)
            batch = batch.filter(pa.array((bloom.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0))
            for slab in slabs(batch.column(1), BLANK, lower=True):
                nodes = [set_node(s) if len(s) else None for s in shingle_sets(slab, n)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1).slice(slab.first, slab.stop - slab.first).cast(pa.string())], schema=schema)

    return run


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of ids(key), of eight bits for each within ngram_join's bounds: it lets others through too, which only costs time."""
    bits = max(ngram_join.LEAST_BLOOM, min(ngram_join.MOST_BLOOM, (8 * ids.count()).bit_length()))
    bit = F.col("key").bitwiseAND((1 << bits) - 1)
    held = ids.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(31).cast("int"))).alias("bits")).toPandas()
    bloom = np.zeros(1 << (bits - 5), np.uint32)
    bloom[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).astype(np.uint32)
    return bloom, bits


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id linked with it, itself included), kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; a document's set are
    its distinct n-word shingles, fewer words are one shingle. Documents link when
    100 * |A n B| >= percent * |A u B|, which is confirmed on the whole sets. kept is
    true where component_id is the document's own id. Null, empty and blank texts have
    no shingles and stay alone. Repeated rows each have a row and share a component;
    rows with a null id link others, get the smallest id linked with them, if any is
    not null, and are kept only if none is. Ids are integers. Other columns are
    ignored; a table without rows gives none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = files_for(text_bytes(docs, "text"))
    meta = cut(docs.mapInArrow(_described(n), "doc_id long, node long, n long, signature binary, low binary"))
    named = meta.where("node is not null")
    nodes = cut(named.where("signature is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("low").alias("low")), files)

    edges, unsure = forest_edges(nodes, percent, files)
    loose = components(edges, files)
    sized = loose.join(nodes.select("node", "n"), "node")
    # sets without neighbours that may have lost one are clusters too
    alone = unsure.join(loose, "node", "left_anti").select("node", F.col("node").alias("root"))
    deep = unsure.join(loose, "node").select("root").distinct().withColumn("deep", F.lit(True))
    sums = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).join(deep, "root", "left")
    sums = cut(sums.select("root", (F.col("deep").isNull() & (F.col("sets") <= SMALL_SETS) & (F.col("tokens") <= SMALL_TOKENS)).alias("small")), files)
    placed = cut(loose.join(sums, "root").select("node", "root", "small").unionByName(alone.withColumn("small", F.lit(False))), files)

    few = placed.where("small").select("node", "root")
    sets = ngram_join._read_sets(docs, named, few.select("node"), n, files)
    by_cluster = sets.join(few, "node").select(F.col("root").alias("cluster"), "node", "tokens").repartition("cluster").sortWithinPartitions("cluster", "node")
    groups = cut(by_cluster.mapInArrow(_confirmed(percent), "node long, least long"), files)
    many = placed.where("not small").select("node")
    if many.limit(1).count():
        keys = named.join(many, "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("key")).select("key")
        bloom, bits = _filter_of(keys)
        held = docs.sparkSession.sparkContext.broadcast(bloom)
        texts = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_named_texts(n, held, bits), "node long, text string")
        texts = cut(texts.join(many, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
        exact = ngram_join.similar_groups(texts, "node", "text", n, percent)
        groups = groups.unionByName(exact.select(F.col("doc_id").alias("node"), F.col("component_id").alias("least")))

    first = named.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = first.join(groups, "node", "left").select("node", "first", F.coalesce("least", "node").alias("root"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = meta.select("doc_id", "node", "n").join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def oracle_sql(n: int, percent: int, with_kept: bool) -> str:
    """The same by comparing all sets that share a shingle."""
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""
    with recursive w as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select row, doc_id, case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) end as s from w),
    m as (select row, doc_id, len(s) as n, md5(array_to_string(s, chr(10))) as node, s from s),
    d as (select node, min(n) as n, any_value(s) as s, min(doc_id) as first from m where n > 0 group by node),
    t as (select node, n, unnest(s) as t from d),
    l as (select a.node as a, b.node as b from t a join t b on a.t = b.t and a.node < b.node and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by 1, 2, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    e as (select a, b from l union all select b, a from l),
    r as (select node, node as other from d union select r.node, e.b from r join e on r.other = e.a),
    c as (select r.node, min(d.first) as component_id from r join d on r.other = d.node group by r.node)
    select m.doc_id, m.n::bigint as n_shingles, case when m.n = 0 then m.doc_id else c.component_id end as component_id{', m.doc_id is not distinct from (case when m.n = 0 then m.doc_id else c.component_id end) as kept' if with_kept else ''} from m left join c on m.n > 0 and m.node = c.node"""
