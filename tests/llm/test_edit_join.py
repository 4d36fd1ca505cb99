"""The edit-distance join against a full distance table over all pairs."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from passagework.llm import edit_join


def full_distance(a, b):
    """Unrestricted Damerau-Levenshtein by its textbook recurrence."""
    last, big = {}, len(a) + len(b)
    d = {(i, -1): big for i in range(-1, len(a) + 1)} | {(-1, j): big for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def changed(r, name, edits):
    w = list(name)
    for _ in range(edits):
        k, at = r.randrange(4), r.randrange(len(w) + 1)
        if k == 0:
            w.insert(at, r.choice("abé😀"))
        elif w and k == 1:
            w.pop(at % len(w))
        elif w and k == 2:
            w[at % len(w)] = r.choice("abé😀")
        elif len(w) > 1:
            at %= len(w) - 1
            w[at], w[at + 1] = w[at + 1], w[at]
    return "".join(w)


def names(seed, n=70):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé😀 ") for _ in range(r.randint(1, 14))) for _ in range(n)]
    return base, [changed(r, x, r.randint(0, 3)) for x in base for _ in range(2)] + ["", None, "a", "ab", "ba", "x" * 3000, "x" * 2999]


def test_distance_is_the_unrestricted_one():
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(400)]
    one, two = words[:200] + ["ca", "abcdef"], words[200:] + ["abc", "abcdef"]
    for most in (1, 2, 3):
        assert edit_join.distances(one, two, most).tolist() == [min(full_distance(a, b), most + 1) for a, b in zip(one, two)]
    assert full_distance("ca", "abc") == 2  # an insertion between exchanged neighbours


def test_pairs_equal_brute_force(spark):
    for most in (1, 2):
        one, two = names(most)
        left = spark.createDataFrame([(x,) for x in [*one, *one, None, "", "x" * 3000]], "name string").withColumn("part", F.lit(1)).withColumn("length", F.lit("clash"))
        right = spark.createDataFrame([(x,) for x in two], "name string").withColumn("query", F.lit("clash")).withColumn("piece", F.lit(0))
        got = Counter(tuple(r) for r in edit_join.similar_names(left, right, most).collect())
        pairs = [(a, b) for a in {*one, "x" * 3000} for b in set(two) if a and b and abs(len(a) - len(b)) <= most and (len(a) < 50 or len(b) > 50)]
        far = lambda a, b: full_distance(a, b) if len(a) < 50 else len(a) - len(b)
        assert got == Counter((a, b, far(a, b)) for a, b in pairs if far(a, b) <= most)
        assert edit_join.similar_names(left.limit(0), right, most).count() == 0
        assert edit_join.similar_names(left, right.limit(0), most).count() == 0


def test_short_names_meet_names_of_pieces(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["a", "ab", "abc", "é"], ["b", "ba", "abcd", "aé", "bc", "abc"]))
    got = {tuple(r) for r in edit_join.similar_names(left, right).collect()}
    want = {(a, b, full_distance(a, b)) for a in ("a", "ab", "abc", "é") for b in ("b", "ba", "abcd", "aé", "bc", "abc") if full_distance(a, b) <= 1}
    assert got == want


def test_match_names(spark):
    r = random.Random(9)
    vendors = [(k, n) for k, n in enumerate(names(5)[0])] + [(3, None), (4, ""), (None, "abcdef"), (900, None), (901, "a"), (902, "ab")]
    vendors += vendors[:3] + [(950, "hot name")] * 5
    stored = []
    for key, name in vendors:
        h = zlib.crc32(str(key).encode())
        if name and key is not None and h % 2 == 0 and len(name) >= 2:
            p = h % (len(name) - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        stored.append((key, name))
    clients = [(k, changed(r, n, r.randint(0, 1)) if n else n) for k, (_, n) in enumerate(stored)]
    clients += [(1000 + k, "hot name" if k % 2 else "hot nmae") for k in range(200)] + [(None, "hot name"), (7000, None), (7001, "")]
    want = {}
    for key, name in set(stored):
        for c, n in clients:
            if name and n and abs(len(n) - len(name)) <= 1 and (far := full_distance(name, n)) <= 1:
                want.setdefault((key, far), []).append(c)
    rows = {(k, far, len(v), min(c for c in v if c is not None) if any(c is not None for c in v) else None, sum(zlib.crc32(str(c).encode()) for c in v if c is not None)) for (k, far), v in want.items()}
    c = spark.createDataFrame(clients, "client_id long, name string").withColumn("n", F.lit("clash")).withColumn("query", F.lit("clash"))
    v = spark.createDataFrame(vendors, "vendor_id long, name string").withColumn("first", F.lit("clash")).withColumn("crc", F.lit(None).cast("string"))
    got = edit_join.match_names(c, v).collect()
    assert {tuple(x) for x in got} == rows and len(got) == len(rows)
    assert edit_join.match_names(c.limit(0), v).count() == 0 == edit_join.match_names(c, v.limit(0)).count()
