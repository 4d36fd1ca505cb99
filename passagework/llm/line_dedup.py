"""Removal of boilerplate lines by the number of distinct sites they are on.

Each line hash has a HyperLogLog sketch of its sites; sketches merge in the
aggregation, so a line on a third of all rows costs one sketch for each task. A
sketch decides alone unless its estimate is near the threshold; near lines get
exact distinct counts. Only built-in expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.blobs import cut

#: Boilerplate line hashes that are broadcast (some 100 bytes each in a hash table); beyond, both sides are dealt by line and one of SALTS.
MOST_SENT, SALTS = 1 << 19, 64
#: 2^LOG_K registers: a relative error of 1.04 / sqrt(2^LOG_K); estimates within DEVIATIONS of them are near.
LOG_K, DEVIATIONS = 12, 6


def _lines(docs: DataFrame) -> DataFrame:
    """(key, site, line hash) of every line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("key", "site", F.explode(F.split(text, "\n")).alias("line"))
    return lines.where(F.trim("line") != "").select("key", "site", _line_hash(F.col("line")).alias("line"))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """(line): hashes of the lines on min_sites distinct sites or more."""
    error = DEVIATIONS * 1.04 / math.sqrt(1 << LOG_K)
    low, high = math.floor(min_sites * (1 - error)) - 1, math.ceil(min_sites * (1 + error)) + 1
    sketches = _lines(docs).groupBy("line").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    judged = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") > low)
    near = judged.where(F.col("sites") < high).select("line")
    exact = _lines(docs).join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return judged.where(F.col("sites") >= high).select("line").unionAll(exact.select("line"))


def clean_lines(docs: DataFrame, min_sites: int = 8, text_col: str = "text", site_col: str = "source", keep_whole: bool = False) -> DataFrame:
    """docs with boilerplate lines out of the text, and columns n_lines and n_removed.

    A line (between \\n, outer blanks aside) goes if it is on min_sites distinct sites
    or more; the rest is joined by \\n. Blank lines stay and null sites aren't
    counted. A null text stays null with 0 lines, an empty one has one line. Repeated
    rows each keep a row. With keep_whole a text of which no line with a word would be
    left stays as it is if the whole text is on two sites or more: copies of a text over
    many sites aren't boilerplate. Other columns pass through, but for older n_lines and n_removed.
    """
    # the row is one struct, so that its columns' names can't meet those used here
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    field = lambda c: F.col("_row").getField(c)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")).withColumn("_key", F.xxhash64(field(text_col), field(site_col)))
    plain = keyed.select(F.col("_key").alias("key"), field(site_col).alias("site"), field(text_col).alias("text"))
    # lines to remove are the most frequent ones by construction, so they aren't joined by their hash alone
    found, lines = cut(boilerplate(plain, min_sites)), _lines(plain)
    if found.count() <= MOST_SENT:
        met = lines.join(F.broadcast(found), "line")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    # equal texts of a site have the same lines: one of them tells which to remove
    bad = met.groupBy(F.col("key").alias("_key")).agg(F.collect_set("line").alias("_bad"))
    kept = F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_bad", _line_hash(x)))
    out = keyed.join(bad, "_key", "left").withColumn("_lines", F.split(field(text_col), "\n")).withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(kept))
    if keep_whole:
        copied = plain.groupBy(F.xxhash64("text").alias("_text")).agg((F.min("site") < F.max("site")).alias("_copied")).where("_copied")
        out = out.withColumn("_text", F.xxhash64(field(text_col))).join(copied, "_text", "left")
        some = F.col("_copied").isNull() | F.exists("_kept", lambda x: F.trim(x) != "")
        out = out.withColumn("_bad", F.when(some, F.col("_bad"))).withColumn("_kept", F.when(some, F.col("_kept")).otherwise(F.col("_lines")))
    null = field(text_col).isNull()
    n_lines = F.when(null, F.lit(0)).otherwise(F.size("_lines")).cast("long")
    removed = F.when(null, F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    text = F.when(F.col("_bad").isNull(), field(text_col)).otherwise(F.array_join("_kept", "\n"))
    return out.select(*((text if c == text_col else field(c)).alias(c) for c in names), n_lines.alias("n_lines"), removed.alias("n_removed"))


def oracle_sql(min_sites: int) -> str:
    return f"""
with d as (select row_number() over () rid, doc_id, source, text from documents),
l as (select rid, doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p from d where text is not null),
b as (select trim(line) t from l where trim(line) <> '' group by 1 having count(distinct source) >= {min_sites}),
k as (select rid, p, line, trim(line) in (select t from b) bad from l),
r as (select rid, count(*) n_lines, count(*) filter (where bad) n_removed, coalesce(string_agg(line, chr(10) order by p) filter (where not bad), '') kept from k group by rid)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join r using (rid)"""
