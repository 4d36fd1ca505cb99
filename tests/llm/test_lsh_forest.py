"""Near-duplicate groups by the forest against all pairs, also where regions are dense or clusters large."""

import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from passagework.llm import lsh_forest
from tests.llm.test_llm import SCHEMA, corpus, groups, near_copies, rows_of


def expected(rows):
    return Counter({(*k, k[0] == k[2]): c for k, c in groups(rows, percent=85).items()})


def crowd(seed=8):
    """Many texts that share a half, which keeps regions dense, among them pairs that barely link, and a group of near copies."""
    r = random.Random(seed)
    vocab = [f"v{k}" for k in range(3000)]
    shared = [r.choice(vocab) for _ in range(40)]
    rows = []
    for k in range(150):
        own = shared + [r.choice(vocab) for _ in range(40)]
        rows.append(" ".join(own))
        if k % 3 == 0:
            for at in r.sample(range(44, 80), 1):
                own[at] = "changed"
            rows.append(" ".join(own))
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(80):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    return [(k, t, "en", "s") for k, t in enumerate(rows)]


def test_equals_all_pairs(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    for name in ("node", "n", "leaf", "signature", "root", "tree", "kept", "component_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(lsh_forest.near_duplicates(docs), *columns) == expected(corpus())
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").select("doc_id", "text").toPandas())
    assert Counter(con.sql(f"select doc_id, n_shingles, component_id, kept from ({lsh_forest.oracle_sql(5, 85, True)})").fetchall()) == expected([x for x in corpus() if x[0] is not None])


def test_dense_regions_and_large_clusters(spark, monkeypatch):
    rows = [(k, t, "en", "s") for k, (_, t, *_) in enumerate(near_copies())] + [(10_000 + k, t, "en", "s") for k, t, *_ in crowd()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(lsh_forest.near_duplicates(docs), *columns) == expected(rows)
    # leaves of a few sets: regions are looked at down to the whole signature, and what that could lose is joined exactly
    monkeypatch.setattr(lsh_forest, "LEAF", 6)
    monkeypatch.setattr(lsh_forest, "SMALL_SETS", 30)
    assert rows_of(lsh_forest.near_duplicates(docs), *columns) == expected(rows)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 63, 2000, np.uint64))
    other = np.unique(np.r_[base[:1600], r.integers(0, 1 << 63, 400, np.uint64)])
    a, b = lsh_forest.signatures([base, other])
    assert abs((a == b).mean() - 1600 / (len(base) + len(other) - 1600)) < 0.15
    assert lsh_forest.linked(base, base[:1700], 85) and not lsh_forest.linked(base, base[:1699], 85)
