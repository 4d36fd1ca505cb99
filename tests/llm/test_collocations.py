"""Phrase counts and scores against plain counting, and the slot table itself."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import collocations


def plain(rows, least, top):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        held = {p: c for p, c in counts.items() if c >= least}
        inner = {}
        for p, c in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner.get(p[i : i + k], 0), c)
        found = []
        for p, a in held.items():
            if len(p) > 1 and not (p in inner and 100 * inner[p] >= 80 * a):
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def corpus(seed=4):
    r = random.Random(seed)
    vocab = ["the", "Of", "é", "straße", "New", "york", "a", "xx", "\xa0", "😀", "long" * 30] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        w = [r.choice(vocab[: r.choice((6, 20, 70))]) for _ in range(r.randint(0, 120))]
        text = "".join(x + r.choice((" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b")) for x in w)
        rows.append((text, r.choice(("en", "en", "fr", None, ""))))
    return rows + rows[:9] + [(None, "en"), ("", None), (" \t\n..", "fr"), ("New york " * 4000, "en"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(corpus(), "text string, lang string").repartition(5)
    for name in ("key", "a", "score", "phrase", "rank", "n", "bucket"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


def test_equals_plain_counting(docs, monkeypatch):
    for least, top in ((3, 2000), (6, 7)):
        got = Counter(tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect())
        assert got == plain(corpus(), least, top) and len(got) > 10
    # few slots: most candidates are counted by key, and most parts' counts are joined
    monkeypatch.setattr(collocations, "SLOTS", 40)
    assert Counter(tuple(r) for r in collocations.collocations(docs, least=6, top=7).collect()) == got
    assert collocations.collocations(docs.limit(0)).count() == 0
    # tasks that were named as having phrases don't have them any more
    monkeypatch.setattr(collocations, "_read_slots", lambda arrays, table, least, real=collocations._read_slots: real(arrays, table, least).withColumn("owner", F.col("owner") + 1000))
    monkeypatch.setattr(collocations, "SLOTS", 1 << 12)
    assert Counter(tuple(r) for r in collocations.collocations(docs, least=6, top=7).collect()) == got


def test_sql_says_the_same(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("text", "lang").toPandas())
    assert Counter(tuple(r) for r in con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({collocations.oracle_sql(6, 50)})").fetchall()) == plain(corpus(), 6, 50)


def test_slot_table_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        table = collocations.SlotTable(r.permutation(keys))
        slots = table.find(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        assert np.array_equal(table.keys[slots], keys)
        others = np.setdiff1d(r.integers(0, 1 << 63, 5000, np.uint64), keys)
        assert (table.find(others) == -1).all()  # they have slots, whose stored keys are others


def test_arrays_and_trees(spark):
    r = np.random.default_rng(2)
    for counts in (np.zeros(900, np.int64), r.integers(0, 3, 900), np.r_[np.zeros(800, np.int64), 1 << 40], r.integers(0, 1 << 20, 50)):
        assert np.array_equal(collocations._decoded(collocations._encoded(counts), len(counts)), counts)
    # more arrays than one task sums up
    rows = [(b, p, None, 4, collocations._encoded(np.array([p, 0, b, 1], np.int64))) for b in range(3) for p in range(200)]
    arrays = spark.createDataFrame(rows, collocations._KEYED_DDL)
    got = {x["bucket"]: collocations._decoded(bytes(x["blob"]), 4).tolist() for x in collocations._tree_sum(arrays, None).collect()}
    assert got == {b: [sum(range(200)), 0, 200 * b, 200] for b in range(3)}


def test_scores_pass_64_bits(spark):
    big = 1 << 61
    row = spark.createDataFrame([(big, 2 * big - 1, 2 * big - 1)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 2_000_000 * big // (4 * big - 2)
