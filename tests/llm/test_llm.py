"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import chat_format, decontaminate, license_scan, line_dedup, mixing, ngram_join, pii, quality_rules, substring_dedup, url_filter
from passagework.llm.components import components
from passagework.llm.queries import DOMAIN_SQL, QUERIES, WEIGHTS, domain
from passagework.llm.words import ALNUM, BLANK, slabs, windows

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANKS.findall(text or "")


def low(text):
    return (text or "").encode().lower().decode()


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 12)))
    vocab = [word() for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(50))
    texts = []
    for k in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(1, 160))]
        if k % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        texts.append(" ".join(w).replace(" ", "\n", 2))
        if k % 5 == 0:
            texts.append(texts[-1])
        if k % 4 == 0:
            near = list(w)
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += [None, "", "  \n\t", "one", "One", "two words", "two words", "a " * 90, "x\x0by\x0cz", " ".join(vocab * 30), "w" * 5000]
    rows = [(k, t, r.choice(["en", "fr", None]), f"src{k % 9}") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", "src1"), (None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves must do no harm
    rows = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    for name in ("key", "node", "n", "_words", "_key", "line", "site", "_bad", "_row", "names", "n_lines", "copies"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def groups(rows, n=5, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return Counter((row[0], len(s), least.get(find(i)) if s else row[0]) for i, (row, s) in enumerate(zip(rows, sets)))


def test_similar_groups(docs, none, monkeypatch):
    got = rows_of(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id")
    assert got == groups(corpus())
    monkeypatch.setattr(ngram_join, "HEAVY", 2)  # nearly everything shared goes to the end of the order
    assert rows_of(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id") == got
    assert ngram_join.similar_groups(none).count() == 0


def near_copies(seed=5):
    """Groups of near copies with changes of their own and shared ones, some linked only through others, with a passage that many hold."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(9)]
    texts = []
    for size, changes, few in ((90, 7, 3), (60, 5, 400), (40, 9, 2)):
        base = [r.choice(vocab) for _ in range(r.randint(50, 90))]
        for k in range(size):
            w = list(base)
            for _ in range(r.randint(0, changes)):
                w[r.randrange(len(w))] = vocab[r.randrange(few)]
            if k % 6 == 0:
                at = r.randrange(len(w))
                w[at:at] = passage[: r.randint(5, 9)]
            texts.append(" ".join(w))
    texts += [" ".join([r.choice(vocab) for _ in range(r.randint(5, 30))] + passage) for _ in range(60)]
    r.shuffle(texts)
    return [(k, t, "en", "s") for k, t in enumerate(texts)]


def test_similar_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # most lists are walked as pairs of blocks
    rows = near_copies()
    want = groups(rows)
    assert len({c for _, _, c in want}) > 60
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 105), (105, 103), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 103: 100, 105: 100}


def removed(rows, length):
    all_ = [words(t) for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + length]) for w in all_ for i in range(len(w) - length + 1))
    out = Counter()
    for (doc, *_), w in zip(rows, all_):
        hit = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                hit.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out[doc, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [35, 5])
def test_remove_repeats(docs, none, length):
    out = substring_dedup.remove_repeats(docs, length=length)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(corpus(), length)
    assert substring_dedup.remove_repeats(none).count() == 0


def plain_longest(symbols, ends):
    """For each position the longest run from it that begins elsewhere too."""
    out = []
    for i in range(len(symbols)):
        best = 0
        for j in range(len(symbols)):
            k = 0
            while i != j and i + k < ends[i] and j + k < ends[j] and symbols[i + k] == symbols[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_matches_and_greedy_factors():
    r = np.random.default_rng(3)
    for letters, m in ((2, 60), (3, 90), (30, 120), (1, 33), (4, 1), (4, 0)):
        for _ in range(6):
            symbols = r.integers(0, letters, m).astype(np.uint64)
            cuts = np.unique(np.r_[r.integers(1, max(m, 2), 5), m])
            cuts = cuts[(cuts > 0) & (cuts <= m)]
            ends = np.repeat(cuts, np.diff(np.r_[0, cuts])) if m else np.zeros(0, np.int64)
            length, source = substring_dedup.longest_matches(symbols, ends)
            assert length.tolist() == plain_longest(symbols, ends)
            for i in np.flatnonzero(length):
                j, n = source[i], length[i]
                assert j != i and (symbols[i : i + n] == symbols[j : j + n]).all() and j + n <= ends[j]
            begin, _, count = substring_dedup.parse(symbols, ends)
            want, i = [], 0  # the greedy parsing position by position
            while i < m:
                if length[i]:
                    want.append((i, length[i]))
                i += max(1, length[i])
            assert sorted(zip(begin.tolist(), count.tolist())) == want


def test_factor_boundaries():
    # 1 2 | 3 4 of the second fragment are two factors; the window at the boundary between them is looked up again
    symbols = np.array([1, 2, 9, 3, 4, 8, 1, 2, 3, 4], np.uint64)
    ends = np.array([6] * 6 + [10] * 4)
    begin, source, count = substring_dedup.parse(symbols, ends)
    assert sorted(zip(begin.tolist(), source.tolist(), count.tolist())) == [(0, 6, 2), (3, 8, 2), (6, 0, 2), (8, 3, 2)]
    text = [f"w{k}" for k in range(120)]
    rows = [" ".join(text[:60]), " ".join(text[60:]), " ".join(text[20:100]), " ".join(text[30:64])]
    # windows over the seam of the first two texts exist only in the third; those of 34 words in none
    got = substring_dedup._Fragments(next(slabs(pa.array(rows), BLANK)), 35)
    whole = [tuple(r.split()[i : i + 35]) for r in rows for i in range(len(r.split()) - 34)]
    hit, _ = substring_dedup.duplicates(got, substring_dedup.plain(next(slabs(pa.array(rows), BLANK)), 4), 35)
    assert hit.tolist() == [whole.count(w) > 1 for w in whole]


def test_equal_rows_tell_each_span_once(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(f"{passage} end").alias("text")).unionByName(spark.createDataFrame([(1, f"own words before {passage}")], "doc_id long, text string"))
    got = substring_dedup.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["count"]) for r in got) == [(0, 91, 91, 20_000), (1, 93, 90, 1)]


def test_remove_repeats_in_a_tree_and_with_colliding_hashes(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLAB_BYTES", 1500)
    monkeypatch.setattr(substring_dedup, "FAN", 4)
    got = substring_dedup.remove_repeats(docs, length=12)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(corpus(), 12)
    # hashes that collide don't make windows equal, words are compared
    rows = ["a b c d e f", "x y z a b c", "q r s t u v", "a b c"]
    slab = next(slabs(pa.array(rows), BLANK))
    f = substring_dedup._Fragments(slab, 3)
    whole = [tuple(r.split()[i : i + 3]) for r in rows for i in range(len(r.split()) - 2)]
    f.hash = np.arange(len(f.hash)).astype(np.uint64) % np.uint64(3)
    hit, odd = substring_dedup.duplicates(f, substring_dedup.plain(slab, 4), 3)
    assert hit.tolist() == [whole.count(w) > 1 for w in whole] and odd.all()


def contaminated(rows, items, width=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = {}
    for name, text in items:
        w = find.findall(low(text))
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wanted.setdefault(tuple(w[i : i + m]), set()).add(str(name))
    out = Counter()
    for doc, text, *_ in rows:
        w, hit, found = find.findall(low(text)), set(), set()
        for m in {len(k) for k in wanted}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wanted:
                    hit.update(range(i, i + m))
                    found |= wanted[tuple(w[i : i + m])]
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("chars,symbols", [(1 << 20, 1 << 20), (300, 64)])
def test_find_benchmark(spark, docs, none, monkeypatch, chars, symbols):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    monkeypatch.setattr(decontaminate, "MOST_SYMBOLS", symbols)
    rows = corpus()
    items = [(k, " ".join(words(rows[k][1])[3:40])) for k in (0, 7, 14, 21)] + [(8, "two words"), (9, ""), (10, None), (11, "absent phrase"), (8, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_benchmark(docs, bench)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contaminated(rows, items)
    assert decontaminate.find_benchmark(none, bench).count() == 0
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("contaminated").count() == 0


def test_removal_spans(spark):
    d = spark.createDataFrame([(1, "é start, Alpha-beta! end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ALPHA beta")], "item_id long, text string")
    assert decontaminate.find_benchmark(d, b, with_text=True).first()["text"] == "é start, ! end"


def test_removal_spans_of_blocks(spark, monkeypatch):
    """A benchmark in several blocks cuts the same text as in one, clean, null and repeated rows included."""
    texts = ["é start, Alpha-beta! gamma delta. end", "Alpha beta, gamma delta; one two", "clean text", "clean text", None, "", "gamma delta"]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, None)], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame([(1, "ALPHA beta"), (2, "gamma delta"), (3, "beta gamma"), (4, "two"), (5, "absent words")], "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text")
    want = rows_of(decontaminate.find_benchmark(d, b, with_text=True), *names)
    assert {t for *_, t in want} >= {"é start, . end", "; one ", "clean text", None, ""}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 8)
    assert rows_of(decontaminate.find_benchmark(d, b, with_text=True), *names) == want


def test_suffix_array_and_index():
    r = np.random.default_rng(2)
    s = np.r_[r.integers(1, 4, 300), 0, r.integers(1, 4, 40), 0]
    index = decontaminate.FMIndex(s, 4)
    for m in (1, 2, 5, 9):
        phrases = np.unique(r.integers(1, 4, (30, m)), axis=0)
        which, lo, hi = index.search(phrases)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
        for k, p in enumerate(phrases):
            assert found.get(k, []) == [i for i in range(len(s) - m + 1) if (s[i : i + m] == p).all()]


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df, *names) == Counter(want.fetchall())


def arrow(rows, fields):
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})


DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]


def test_quality_rules(docs, none):
    same_as_sql(quality_rules.judge(docs).drop("broken"), quality_rules.oracle_sql(), documents=arrow(corpus(), DOCS))
    kept = rows_of(quality_rules.judge(docs).where("kept"), "doc_id")
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and rows_of(good, "doc_id") == kept
    assert quality_rules.keep_good(none).count() == 0 == quality_rules.judge(none).count()


@pytest.mark.parametrize("sites", [2, 5])
def test_line_dedup(docs, none, sites):
    out = line_dedup.clean_lines(docs, sites).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    same_as_sql(out, line_dedup.oracle_sql(sites), documents=arrow(corpus(), DOCS))
    assert line_dedup.clean_lines(none, sites).count() == 0
    assert line_dedup.clean_lines(docs, 1000).where("n_removed > 0").count() == 0


def test_whole_copies_may_stay(spark):
    rows = [(k, "same line\n" + ("other same" if k else "its own"), f"s{k}") for k in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["text"] for r in line_dedup.clean_lines(d, 3).orderBy("doc_id").collect()] == ["its own", "", "", ""]
    assert [(r["text"], r["n_removed"]) for r in line_dedup.clean_lines(d, 3, keep_whole=True).orderBy("doc_id").collect()] == [("its own", 1)] + [(rows[1][1], 0)] * 3


def test_mixed_boilerplate_goes(spark):
    """A page of nothing but site boilerplate that no other site has as a whole loses its lines also with keep_whole."""
    rows = [(k, f"menu\nfooter\nits own {k}", f"s{k}") for k in range(3)] + [(3, "menu\nfooter", "s3"), (4, "footer\nmenu", "s4"), (5, "footer\nmenu", "s5"), (6, "menu\nmenu", "s6"), (7, "menu\nmenu", "s6"), (8, "footer", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean_lines(d, 3, keep_whole=True).collect()}
    assert out == {k: f"its own {k}" for k in range(3)} | {3: "", 4: "footer\nmenu", 5: "footer\nmenu", 6: "", 7: "", 8: ""}


def test_many_boilerplate_lines_are_salted(spark, docs, monkeypatch):
    sent = rows_of(line_dedup.clean_lines(docs, 2), "doc_id", "text", "n_removed")
    monkeypatch.setattr(line_dedup, "MOST_SENT", 0)
    assert rows_of(line_dedup.clean_lines(docs, 2), "doc_id", "text", "n_removed") == sent


def test_near_lines_are_exact(spark):
    """Sketches alone can't tell 99 from 100 sites."""
    rows = [(k, f"{'a' if k < 99 else 'x'}\n{k}", f"s{k}") for k in range(120)] + [(200 + k, "b", f"s{k}") for k in range(100)]
    out = line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 100)
    assert out.agg(F.sum("n_removed")).first()[0] == 100


@pytest.mark.parametrize("total", [0, 300, 5000, 10**6, None])
def test_mixing(docs, none, total):
    same_as_sql(mixing.mix(docs, domain(), total, WEIGHTS, percent=70), mixing.oracle_sql(DOMAIN_SQL.replace("'{g}'", "'', 'g'"), total, WEIGHTS, percent=70), documents=arrow(corpus(), DOCS))
    assert mixing.mix(none, domain(), total, WEIGHTS).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "fr", "c", 1000), ("books", "en", "d", 5)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 400, {}, 1).collect()}
    # books is short (5 of 200), so web has 395: en 197 (a is full, b takes the rest), fr 197
    assert got == {"a": 10, "b": 187, "c": 197, "d": 5}


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 5, None, "x"), (5, None, "user", None), (6, 5, "", "x"), (7, 0, "user", ""), (8, 0, "user", None), (9, 0, "user", "hi"), (9, 0, "user", "hi"), (None, 0, "user", "lost"), (10, 3000, "user", "late"), (10, 1, "user", "b"), (10, 1, "user", "a"), (11, 1, "user", "b"), (11, 1, "user", "a")]


def test_chat_format(spark):
    log = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).repartition(3)
    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    same_as_sql(chat_format.format_chats(log), chat_format.oracle_sql(), conversations=arrow(CHATS, fields))
    kept = {r["conv_id"] for r in chat_format.format_chats(log).collect()}
    assert {2, 4, 10} <= kept and not {1, 3, 9, 11} & kept
    # numbers only give the order: a copy that counts from 1, or by tens, is the same conversation
    shifted = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (3, 0, "user", "a"), (3, 5000, "assistant", "b"), (3, 90000, "user", "c <|im_end|> <\\\\|im_start|> <x>"), (4, None, "user", "a"), (4, 7, "assistant", "z")]
    made = chat_format.format_chats(spark.createDataFrame(shifted, "conv_id long, turn long, role string, text string"))
    same_as_sql(made, chat_format.oracle_sql(), conversations=arrow(shifted, fields))
    got = {r["conv_id"]: r for r in made.withColumn("back", chat_format.unescape(F.col("text"))).collect()}
    assert set(got) == {3, 4} and got[3]["n_turns"] == 3
    # the three turns' own marks are the only ones in the rendered text, and the escaped text comes back
    assert got[3]["text"].count("<|im_end|>") == 3 and shifted[6][3] in got[3]["back"]
    assert chat_format.format_chats(log.limit(0)).count() == 0


URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q=/fr/", "https://example.com/en", "https://example.com/en/2", "http://b.net/es/", "http://b.net/es", "net://net/fr/x#y", "http://example.community/en/", "no scheme", None, "", "http://", "http://com", "http://casino-win.example.org/a", "http://m.casino-win.example.org", "http://xcasino-win.example.org/", "x://a://b.com/", "http://" + "a." * 2000 + "com/", "http://é.com/É?"]


def test_url_filter(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[0])], "page_id long, url string").withColumn("host", F.lit(1)).repartition(2)
    table = arrow([*enumerate(URLS), (3, URLS[3]), (None, URLS[0])], [("page_id", pa.int64()), ("url", pa.string())])
    out = url_filter.filter_urls(pages)
    same_as_sql(out, url_filter.oracle_sql(), pages=table)
    # with a digest that always collides, the strings decide; small blocks change nothing
    same_as_sql(url_filter.filter_urls(pages, hash_=_one), url_filter.oracle_sql(), pages=table)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def _one(key):
    return 1


def test_digest_blocks(monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK_BYTES", 60)
    keys = [f"host{k}.org" for k in range(20)]
    blocks = [url_filter.Digests(b) for b in url_filter.pack_keys([(k, i) for i, k in enumerate(keys)])]
    assert len(blocks) > 5
    asked = [k.encode() for k in [*keys, "other"]]
    h = np.array([url_filter.digest(k) for k in asked], np.uint64)
    assert np.max([b.find(asked, h) for b in blocks], axis=0).tolist() == [*range(20), -1]


def test_license_scan(spark):
    long = license_scan.TEMPLATES["MIT-notice"]
    changed = long.replace("free of charge", "without a charge").upper()
    rows = [(1, "é intro.\nReleased under the MIT License. more"), (2, "nothing here"), (3, None), (4, ""), (5, f"head {changed} tail"), (6, "Released under the MIT License. " * 3), (None, "Licensed under CC BY-NC 4.0."), (7, "the MIT licence released under")]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    found = {(r["doc_id"], r["license"]) for r in out}
    assert found == {(1, "MIT"), (5, "MIT-notice"), (6, "MIT"), (None, "CC-BY-NC-4.0")}
    one = next(r for r in out if r["doc_id"] == 1)
    assert rows[0][1][one["start"] : one["end"]] == "Released under the MIT License" and one["coverage"] == 1.0
    assert sum(r["doc_id"] == 6 for r in out) == 3
    five = next(r for r in out if r["doc_id"] == 5)
    assert 0.9 < five["coverage"] < 1 and rows[4][1][five["start"] :].startswith("PERMISSION")


def test_license_scan_loses_no_match(spark):
    """Against an alignment at every diagonal: changed, left out and inserted words, also where no three words in a row are kept."""
    r, rows = random.Random(6), [(0, "Released under an MIT License"), (1, "Released under MIT License"), (2, "Licensed under CC XX NC 4.0")]
    while len(rows) < 120:
        name = r.choice(list(license_scan.TEMPLATES))
        w = license_scan.TEMPLATES[name].split()
        for _ in range(r.randint(1, max(1, len(w) // 4))):
            k, how = r.randrange(len(w)), r.randrange(3)
            w[k : k + 1] = [["other"], [], [w[k], "more"]][how]
        rows.append((len(rows), " ".join(["intro"] * r.randint(0, 4) + w + ["the", "end"])))
    index, want = license_scan.Index(license_scan.TEMPLATES), set()
    for slab in slabs(pa.array([t for _, t in rows]), ALNUM, lower=True):
        h = slab.hashes()
        for row, (a, b) in enumerate(zip(slab.bounds[:-1], slab.bounds[1:]), slab.first):
            for t, words_ in enumerate(index.words):
                if any(license_scan.align(words_, h[a:b], d, index.band(t) + 1)[0] >= 0.8 * len(words_) for d in range(-len(words_), b - a)):
                    want.add((row, index.names[t]))
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(0, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0")} <= want
    assert want <= {(x["doc_id"], x["license"]) for x in out} and all(x["coverage"] >= 0.8 for x in out)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_base_spans():
    r = random.Random(4)
    parts = ["a@b.c", "a@b", "x.y@m-1.example.com", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "010.0.0.1", "4539 1488 0343 6467", "4539148803436467", "4539148803436468", "+1 (017) 555-7713", "+1", "++12345678901", " ", "\n", "é", "word", "-", ".", "12", "a@b.c@d.e", "_"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), text
    pii.base_spans("a" * 200_000 + "@ " + "1" * 200_000)  # in linear time


def test_personal(spark):
    card = "4539148803436467"
    rows = [(1, "call +1 (017) 555-7713 now or later\n(017) 555-7713 again"), (2, None), (3, ""), (4, f"token = \"{'a1b2c3d4' * 5}\" é"), (5, f"page 12 of 2024, version 3.1, {card}"), (None, "x@y.org"), (6, "plain words only"), (6, "plain words only"), (7, "7 " * 3000)]
    out = {r["doc_id"]: r for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1]["n_phone"], out[1]["n_added"]) == (1, 1) and out[1]["spans"].startswith("phone:5:22,phone:")
    assert out[4]["n_secret"] == 1 and out[5]["n_card"] == 1 and out[5]["n_added"] == 0 and out[None]["n_email"] == 1
    assert all(out[k]["spans"] == "" for k in (2, 3, 6, 7)) and out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("full_first", [True, False])
def test_far_mentions_agree(full_first):
    """However often and far from the full form, each bare mention is found; other numbers aren't."""
    full, bare = "call +1 (234) 555-0000 now", " ".join(["word then (234) 555-0000 again"] * 50)
    text = f"{full} {bare}" if full_first else f"{bare} {full}"
    base, all_ = pii.spans([text + " page 12 of 2024"], pii.Field.train())[0]
    assert [k for k, *_ in base] == ["phone"]
    phones = [text[a:b] for k, a, b in all_ if k == "phone"]
    assert len(all_) == len(phones) == 51 and all(p.endswith("555-0000") for p in phones)


def test_field_ends_when_messages_stay():
    """A long chain: a message from one end reaches the other, as in exact forward-backward sums."""
    m = len(pii.LABELS)
    field = pii.Field(np.eye(15, m) * 0, 4 * np.eye(m), np.zeros((m, m)))
    field.w[5] = 3 * np.eye(m)[4]
    x = np.zeros((40, 15))
    x[0, 5] = 1
    p = field.marginals(x, [(k, k + 1) for k in range(39)], [])
    step = np.exp(field.chain)
    want = [np.exp(field.w[5]) @ np.linalg.matrix_power(step, k) for k in range(40)]
    assert np.allclose(p, [w / w.sum() for w in want], atol=1e-4)


def test_field_on_held_out_sentences():
    field, hits, found, want = pii.Field.train(), 0, 0, 0
    for text, gold in pii.examples(200, seed=99):
        got = {s for s in pii.spans([text], field)[0][1]}
        wanted = {(k, *((a + 1, b - 1) if k == "secret" else (a, b))) for k, a, b in gold}
        hits, found, want = hits + len(got & wanted), found + len(got), want + len(wanted)
    assert hits / want > 0.95 and hits / found > 0.95


def test_word_hashes_do_not_depend_on_place():
    texts = pa.array(["abc abc", None, "xabc  abc\u00e9 " + "q" * 100, "q" * 100])
    for size in (1, 1 << 20):
        found = {}
        for slab in slabs(texts, BLANK, slab_bytes=size):
            for i, h in enumerate(slab.hashes().tolist()):
                assert found.setdefault(slab.word(i), h) == h
        assert len(found) == len(set(found.values())) == 4
    assert [s.word(0) for s in slabs(pa.array(["A-b"]), ALNUM, lower=True)] == [b"a"]
    assert len(windows(np.arange(10, dtype=np.uint64), 7)) == 4


def test_pipeline(spark, tmp_path):
    """The whole pipeline against plain versions of its stages (and SQL for the last)."""
    r = random.Random(8)
    vocab = ["the", "of", "and", "to", "in"] + ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows, phrase = [], say(14)
    for k in range(120):
        text = f"{say(40)}\nA boiler plate line of words here\n{say(30)}"
        if k % 10 == 1:
            text = rows[-1][1]
        if k % 10 == 2:
            text = rows[-1][1] + " end"
        if k % 15 == 4:
            text += "\n" + phrase
        if k % 15 == 6:
            text = " ".join(w + "###" for w in text.split())
        rows.append((k, text, r.choice(["en", "fr"]), f"src{k % 12}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [x for x in rows if "###" not in x[1]]
    lines = {}
    for _, t, _, s, _ in kept:
        for x in t.split("\n"):
            lines.setdefault(x, set()).add(s)
    kept = [(d, "\n".join(x for x in t.split("\n") if len(lines[x]) < 8), g, s) for d, t, g, s, _ in kept]
    root = {d: c for d, _, c in groups(kept)}
    kept = [x for x in kept if root[x[0]] == x[0]]
    kept = [x for x in kept if phrase not in x[1]]
    total = sum(len(words(x[1])) for x in kept) * corpus_pipeline.MIX_PERCENT // 100
    con = duckdb.connect()
    con.register("documents", arrow(kept, DOCS))
    want = con.execute(mixing.oracle_sql(DOMAIN_SQL.replace("'{g}'", "'', 'g'"), total, WEIGHTS)).fetchall()
    assert want and {(x["doc_id"], x["copies"]) for x in out} == {(x[0], x[-1]) for x in want}
    texts = {x[0]: x[1] for x in kept}
    assert all(x["text"] == texts[x["doc_id"]] and x["n_chars"] == len(x["text"]) for x in out)


def test_pipeline_drops_only_judged_rows(spark, tmp_path):
    """Null and repeated ids: a row's removal takes no other row along."""
    r = random.Random(3)
    say = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    a, b, c, d, e, f, g, phrase = (say() for _ in range(8))
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (5, d), (5, d), (5, e), (7, a + " more"), (7, f), (None, g), (None, g + " end"), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = rows_of(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)), "doc_id", "text")
    last = [x for x in ((None, g), (None, g + " end")) if x in out]
    assert len(last) == 1
    assert out == Counter([(1, a), (None, b), (None, c), (5, d), (5, e), (7, f), *last, (None, None), (None, None), (8, ""), (8, "")])
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a + " " + phrase), (None, b), (4, phrase), (4, c), (4, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    assert rows_of(corpus_pipeline.benchmark(spark, docs, str(tmp_path)), "doc_id", "text") == Counter([(None, b), (4, c), (4, c), (None, None)])


def test_pipeline_stages_take_odd_rows(spark, docs, none, tmp_path):
    """Nulls in any column, repeated rows, clashing names and no rows at all, in each stage."""
    long = " ".join(f"the w{k} of and" for k in range(3000))
    odd = docs.withColumn("n_chars", F.length("text").cast("long"))
    odd = odd.unionByName(spark.createDataFrame([(900, long, None, None, None), (900, long, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    spark.createDataFrame([(1, "w3 of and the w4 of and the w5 of and"), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        if name == "quality rules":
            want = quality_rules.judge(odd.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")).where("kept").select("doc_id")
            assert rows_of(out.select(F.xxhash64("doc_id", "text").alias("k")), "k") == rows_of(want, "doc_id")
        if name == "line dedup":
            assert out.count() == odd.count() and out.where("text is null").count() == odd.where("text is null").count()
        if name == "benchmark decontamination":
            assert out.where("doc_id = 900").count() == 0 and out.where("text is null").count() == odd.where("text is null").count()
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and "_key" not in out.columns
        empty = stage(spark, none.withColumn("n_chars", F.lit(None).cast("long")), str(tmp_path))
        assert empty.count() == 0


def test_field_in_blocks(monkeypatch):
    """Messages computed a few edges at a time are the same."""
    field = pii.Field.train()
    texts = [t for t, _ in pii.examples(40, 9)]
    whole = pii.spans(texts, field)
    monkeypatch.setattr(pii, "EDGES", 3)
    assert pii.spans(texts, field) == whole


def test_field_is_exact_on_trees():
    """Marginals of a small tree of chain and skip edges against the sum over all labellings."""
    r, m = np.random.default_rng(4), len(pii.LABELS)
    field = pii.Field(r.normal(size=(15, m)), r.normal(size=(m, m)), (lambda k: k + k.T)(r.normal(size=(m, m))))
    x = r.normal(size=(5, 15))
    x[:, 1:5] = 0
    chain, skip = [(0, 1), (2, 3)], [(1, 2), (1, 4)]
    got, want = field.marginals(x, chain, skip), np.zeros((5, m))
    for labels in np.ndindex(*[m] * 5):
        score = sum((x[k] @ field.w)[y] for k, y in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for k, y in enumerate(labels):
            want[k, y] += np.exp(score)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-4)


def test_every_operator_has_a_query():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
