"""The operators on the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.llm import chat_format, collocations, decontaminate, edit_join, license_scan, line_dedup, lsh_forest, mixing, ngram_join, pii, quality_rules, substring_dedup, url_filter

MIN_SITES = 8
#: Budget of the mixing query in percent of all tokens, and the tree's weights; sources' domains follow from their number.
MIX_PERCENT = 60
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}
DOMAIN_SQL = "case cast(nullif(regexp_replace(source, '[^0-9]', '{g}'), '') as bigint) % 3 when 0 then 'web' when 1 then 'books' when 2 then 'news' else 'other' end"


def domain():
    number = F.nullif(F.regexp_replace("source", "[^0-9]", ""), F.lit("")).cast("bigint") % 3
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "news").otherwise("other")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    d = line_dedup.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIN_SITES)
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("broken")


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), domain(), None, WEIGHTS, percent=MIX_PERCENT)


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text")


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lsh_forest(spark, sf_dir):
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op13_edit_join(spark, sf_dir):
    return edit_join.match_names(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_ngram_jaccard, op4_substring_dedup, op5_quality_rules, op6_mixing, op7_license_scan, op8_pii, op9_decontaminate, op10_url_filter, op11_collocations, op12_lsh_forest, op13_edit_join, pipeline)}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.oracle_sql(MIN_SITES),
    "op2_chat_format": chat_format.oracle_sql(),
    "op3_ngram_jaccard": lsh_forest.oracle_sql(5, 75, False),
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op6_mixing": mixing.oracle_sql(DOMAIN_SQL.replace("'{g}'", "'', 'g'"), None, WEIGHTS, percent=MIX_PERCENT),
    "op10_url_filter": url_filter.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
    "op12_lsh_forest": lsh_forest.oracle_sql(5, 85, True),
    "op13_edit_join": edit_join.oracle_sql(),
}
