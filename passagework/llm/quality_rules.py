"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in column expressions. Measures that several others need
(words, windows) are columns of their own, so that each is computed once a row;
no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish (a parameter).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "est", "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "für", "nicht", "ein", "eine", "el", "los", "las", "y", "del", "por", "con", "para", "se", "no")
#: (rule, measure, least, most); None sets no bound. The unit is the measure's own.
RULES = (
    ("word length", "mean_word_chars", 1.5, 14.0),
    ("symbols", "symbols_per_word", None, 0.25),
    ("stop words", "stop_word_share", 0.01, None),
    ("repeated lines", "dup_line_share", None, 0.5),
    ("ellipsis lines", "ellipsis_line_share", None, 0.5),
    ("letters", "letter_share", 0.5, None),
)


def _repeat_words(n: int) -> Column:
    """Words inside the union of windows whose hash is there twice or more.

    Windows are sorted with their positions; neighbours of equal hash repeat.
    """
    repeated = """
      transform(filter(sequence(0, size(_ranked) - 1),
                       i -> (i > 0 and get(_ranked, i - 1).h = _ranked[i].h)
                         or (i < size(_ranked) - 1 and get(_ranked, i + 1).h = _ranked[i].h)),
                i -> _ranked[i].p)"""
    covered = f"""
      aggregate(array_sort({repeated}), named_struct('n', 0L, 'to', -1),
                (a, p) -> named_struct('n', a.n + cast(p + {n} - greatest(a.to, p) as bigint), 'to', p + {n}),
                a -> a.n)"""
    return F.expr(f"case when _ranked is null then 0L else {covered} end")


def measure(docs: DataFrame, text_col: str = "text", window: int = 8, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """docs with columns `_q_*` of measures; null texts count as empty.

    window is a power of two: hashes of 1, 2, 4 ... words are joined pairwise, so a
    window's hash costs log(window) steps whatever the words are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    size = 1
    while size < window:
        # the last entries lack a partner; they are cut off below
        d = d.withColumn("_hashes", F.expr(f"zip_with(_hashes, slice(_hashes, {size + 1}, greatest(size(_hashes) - {size}, 0)), (a, b) -> xxhash64(a, b))"))
        size *= 2
    d = d.withColumn("_hashes", F.expr(f"slice(_hashes, 1, greatest(size(_words) - {window - 1}, 0))"))
    d = d.withColumn("_ranked", F.expr("case when size(array_distinct(_hashes)) < size(_hashes) then array_sort(transform(_hashes, (h, i) -> named_struct('h', h, 'p', i))) end"))
    n, lines = F.size("_words").cast("long"), F.size("_lines").cast("long")
    found = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": lines - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(window),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop_words))).cast("long"),
        "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_lines": lines,
    }
    # a filter on plain aliases would be pushed to the scan with the measures written out in it, many times over;
    # it can't go below a generator, so each measure is computed once
    measured = d.select(*docs.columns, *(c.alias(f"_q_{k}") for k, c in found.items()))
    return measured.select(*docs.columns, F.explode(F.array(F.struct(*(f"_q_{k}" for k in found)))).alias("_q")).select(*docs.columns, "_q.*")


def _shares() -> dict[str, Column]:
    q = lambda c: F.col(f"_q_{c}").cast("double")
    over = lambda a, b: F.when(q(b) > 0, q(a) / q(b)).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "stop_word_share": over("n_stop_words", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "ellipsis_line_share": over("n_ellipsis_lines", "n_lines"),
        "letter_share": over("n_letter_words", "n_words"),
    }


def verdict(rules=RULES) -> Column:
    """Names of the rules a measured row breaks, as an array."""
    shares, broken = _shares(), []
    for name, key, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (shares[key] < least)
        if most is not None:
            bad = bad | (shares[key] > most)
        broken.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def base_failed(least_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("_q_n_words") < least_words) | (100 * F.col("_q_n_repeat_words") > repeat_percent * F.col("_q_n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken (rule names).

    Words are runs of anything but ASCII white space. Null and empty texts have no
    words and fail the base rule; repeated rows each have a row; ids may be null.
    Other columns are ignored.
    """
    m = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    m = m.withColumn("base_failed", base_failed()).withColumn("broken", verdict(rules))
    return m.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns (a text column is needed)."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    m = measure(row, "_text")
    return m.where(~base_failed() & (F.size(verdict(rules)) == 0)).select("_row.*")


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') text, {_WORDS} words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from documents),
g as (select rid, p, list_slice(words, p, p + 7) g from d, unnest(generate_series(1, len(words) - 7)) u(p) where len(words) >= 8),
r as (select rid, p, count(*) over (partition by rid, g) c from g),
c as (select rid, count(distinct q) n from r, unnest(generate_series(p, p + 7)) v(q) where c > 1 group by rid),
m as (select doc_id, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(lines) n_lines,
             len(list_filter(words, lambda w: lower(w) in ({stop}))) n_stop, len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}'))) n_letter,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) n_ell
      from d left join c using (rid)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars::double / n_words between 1.5 and 14.0 and n_symbols::double / n_words <= 0.25
       and n_stop::double / n_words >= 0.01 and n_dup_lines::double / n_lines <= 0.5 and n_ell::double / n_lines <= 0.5 and n_letter::double / n_words >= 0.5 kept
from v"""
