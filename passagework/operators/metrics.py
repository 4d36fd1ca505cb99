"""Metrics as long tables (sample_id, metric, value); a metric that doesn't apply has no row.

samples(sample_id, question, answers array<string>, gold_doc_ids array<...>),
hits(sample_id, rank, doc_id, text) and answers(sample_id, text, citations).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import nfkc_each, normalize, tokens
from passagework.operators.calls import said

RETRIEVAL = ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")
ANSWER = ("exact_match", "answer_contains", "token_f1", "rouge_l", "faithfulness", "context_recall")
DIGITS = 9


def _long(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), DIGITS).alias("value")) for k, v in values.items()])
    return rows.select("sample_id", F.inline(entries))


def doc_ranks(hits: DataFrame) -> DataFrame:
    """(sample_id, doc_id, doc_rank): distinct documents in the order of their first chunk."""
    first = hits.groupBy("sample_id", "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank", "doc_id"))).drop("rank")


def retrieval_metrics(samples: DataFrame, hits: DataFrame, k: int = 5, names: tuple[str, ...] = RETRIEVAL) -> DataFrame:
    """All six from one aggregation: top documents are flagged against the gold list, kept by a left join so that misses count as 0."""
    gold = samples.where(F.size("gold_doc_ids") > 0).select("sample_id", "gold_doc_ids")
    top = doc_ranks(hits).where(F.col("doc_rank") <= k)
    flagged = gold.join(top, "sample_id", "left").withColumn("rel", F.when(F.array_contains("gold_doc_ids", F.col("doc_id")), 1).otherwise(0))
    seen = F.sum("rel").over(Window.partitionBy("sample_id").orderBy("doc_rank").rowsBetween(Window.unboundedPreceding, 0))
    flagged = flagged.withColumn("seen", seen)
    g = flagged.groupBy("sample_id").agg(
        F.first("gold_doc_ids").alias("gold"),
        F.sum("rel").alias("hits"),
        F.count("doc_id").alias("docs"),
        F.min(F.when(F.col("rel") == 1, F.col("doc_rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("doc_rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("doc_rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    most = F.least(F.size("gold"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    values = {
        "recall": F.col("hits") / F.size(F.array_distinct("gold")),
        "precision": F.when(F.col("docs") > 0, F.col("hits") / F.col("docs")).otherwise(0.0),
        "hit_rate": (F.col("hits") > 0).cast("double"),
        "mrr": F.coalesce(1 / F.col("first"), F.lit(0.0)),
        "map": F.col("ap") / most,
        "ndcg": F.col("dcg") / ideal,
    }
    return _long(g, {f"{n}@{k}": values[n] for n in names})


def _answered(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Samples with a non-empty answer, joined with the prediction (empty if missing)."""
    some = samples.where(F.exists("answers", lambda a: F.coalesce(a, F.lit("")) != ""))
    return some.join(answers.select("sample_id", F.col("text").alias("pred")), "sample_id", "left").withColumn("pred", F.coalesce("pred", F.lit("")))


def exact_match(samples: DataFrame, answers: DataFrame) -> DataFrame:
    return _long(_answered(samples, answers).withColumn("np", normalize(F.col("pred"))), {"exact_match": F.exists(nfkc_each(F.col("answers")), lambda a: normalize(a, False) == F.col("np")).cast("double")})


def answer_contains(samples: DataFrame, answers: DataFrame) -> DataFrame:
    hit = F.exists(nfkc_each(F.col("answers")), lambda a: (normalize(a, False) != "") & F.col("np").contains(normalize(a, False)))
    return _long(_answered(samples, answers).withColumn("np", normalize(F.col("pred"))), {"answer_contains": hit.cast("double")})


def token_f1(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Multiset overlap with the answer of the best F1, the first on ties."""
    rows = _answered(samples, answers).select("sample_id", tokens(F.col("pred")).alias("p"), F.posexplode("answers").alias("a_idx", "answer")).withColumn("g", tokens(F.col("answer")))
    sizes = rows.select("sample_id", "a_idx", F.size("p").alias("np"), F.size("g").alias("ng"))
    counts = lambda c: rows.select("sample_id", "a_idx", F.explode(c).alias("t")).groupBy("sample_id", "a_idx", "t").agg(F.count("*").alias(c))
    common = counts("p").join(counts("g"), ["sample_id", "a_idx", "t"]).groupBy("sample_id", "a_idx").agg(F.sum(F.least("p", "g")).alias("common"))
    j = sizes.join(common, ["sample_id", "a_idx"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("common") / F.col(n)).otherwise(0.0)
    j = j.withColumn("pr", ratio("np")).withColumn("rc", ratio("ng")).withColumn("f1", F.when(F.col("common") > 0, F.round(2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc")), DIGITS)).otherwise(0.0))
    best = j.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("f1"), "a_idx"))).where("n = 1")
    zero = lambda c: F.when(F.col("f1") > 0, F.col(c)).otherwise(0.0)
    return _long(best, {"token_f1": F.col("f1"), "token_precision": zero("pr"), "token_recall": zero("rc")})


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows (one integer holds a row of the table)."""
    at: dict[str, int] = {}
    for i, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << i
    row = (1 << len(b)) - 1
    full = row
    for t in a:
        m = at.get(t, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def _best_lcs(pred: pd.Series, answers: pd.Series) -> pd.Series:
    out = []
    for p, many in zip(pred, answers):
        best, p = 0.0, list(p)
        for g in map(list, many):
            n = lcs(p, g) if p and g else 0
            best = max(best, 2 * n / (len(p) + len(g)) if n else 0.0)
        out.append(best)
    return pd.Series(out)


def rouge_l(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """LCS F1, the best of the answers; the only answer metric that runs as an Arrow batch, since the table is quadratic."""
    rows = _answered(samples, answers)
    rouge = F.pandas_udf(_best_lcs, "double")
    return _long(rows, {"rouge_l": rouge(tokens(F.col("pred")), F.transform(nfkc_each(F.col("answers")), lambda a: tokens(a, exact=False)))})


def _contexts(samples: DataFrame, hits: DataFrame) -> DataFrame:
    joined = hits.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), " ").alias("ctx"))
    return samples.join(joined, "sample_id", "left").withColumn("ctx", F.coalesce("ctx", F.lit("")))


def context_recall(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """Best share of an answer's tokens that are substrings of the contexts; whether a whole answer is."""
    some = samples.where(F.exists("answers", lambda a: F.coalesce(a, F.lit("")) != ""))
    rows = _contexts(some, hits).withColumn("nc", normalize(F.col("ctx"))).select("sample_id", "nc", F.explode("answers").alias("a")).withColumn("t", tokens(F.col("a")))
    share = F.when(F.size("t") > 0, F.size(F.filter("t", lambda t: F.col("nc").contains(t))) / F.size("t")).otherwise(0.0)
    inside = (normalize(F.col("a")) != "") & F.col("nc").contains(normalize(F.col("a")))
    best = rows.groupBy("sample_id").agg(F.max(share).alias("cr"), F.max(inside.cast("double")).alias("ai"))
    return _long(best, {"context_recall": F.col("cr"), "answer_in_context": F.col("ai")})


def faithfulness(samples: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of the prediction's tokens among the contexts' tokens; whether it cites anything. An empty prediction has 0 and 0."""
    cited = answers.select("sample_id", tokens(F.col("text")).alias("p"), F.coalesce(F.size("citations"), F.lit(0)).alias("nc"))
    rows = _contexts(samples.select("sample_id"), hits).join(cited, "sample_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    rows = rows.withColumn("ct", F.array_distinct(tokens(F.col("ctx"))))
    hit = F.when(F.size("p") > 0, F.size(F.filter("p", lambda t: F.array_contains("ct", t))) / F.size("p")).otherwise(0.0)
    return _long(rows, {"faithfulness": hit, "citation_rate": F.when((F.size("p") > 0) & (F.col("nc") > 0), 1.0).otherwise(0.0)})


JUDGE_PROMPT = 'Judge the answer by the question, the material and the reference answer, from 0 to 1 each: correctness, faithfulness, relevance. Give a short reason, then one line of JSON: {"correctness":x,"faithfulness":y,"relevance":z}'


def parse_judgement(raw: str) -> dict[str, float] | None:
    """The last {...} of an answer, or None."""
    try:
        found = json.loads(re.findall(r"\{[^{}]*\}", raw)[-1])
        return {f"judge_{k}": float(found.get(k, 0.0)) for k in ("correctness", "faithfulness", "relevance")}
    except (IndexError, ValueError, TypeError):
        return None


def llm_judge(samples: DataFrame, hits: DataFrame, answers: DataFrame, llm, max_context_chars: int = 3000) -> DataFrame:
    """Three grades by a model; a failed call or an answer that can't be read gives no rows."""
    rows = _contexts(samples, hits).join(answers.select("sample_id", F.col("text").alias("pred")), "sample_id", "left")
    text = F.concat(F.lit(JUDGE_PROMPT + "\n\nQuestion: "), "question", F.lit("\n\nMaterial:\n"), F.substring("ctx", 1, max_context_chars), F.lit("\n\nReference: "), F.array_join("answers", " / "), F.lit("\n\nAnswer: "), F.coalesce("pred", F.lit("")))

    asked = said(rows.select("sample_id", text.alias("_p")), "_p", llm)

    @F.pandas_udf("map<string,double>")
    def judged(raw: pd.Series) -> pd.Series:
        return raw.map(lambda a: None if a is None else parse_judgement(a))

    return asked.select("sample_id", F.explode(judged("answer")).alias("metric", "value"))


def latency(timings: dict[str, float], n: int) -> dict[str, float]:
    """Wall-clock seconds of each stage divided by the number of questions: a batched plan has no time of a single one."""
    return {f"latency_{stage}": s / max(n, 1) for stage, s in timings.items()}


def summary(scores: DataFrame) -> DataFrame:
    """(metric, value, n): mean over the samples that have the metric."""
    return scores.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def delta(summaries: DataFrame, baseline: str) -> DataFrame:
    """summaries(variant, metric, value) with value minus the baseline's (0 if it has none); @k names are compared without k."""
    base = F.regexp_replace("metric", "@.*$", "")
    first = summaries.where(F.col("variant") == baseline).select(base.alias("_m"), F.col("value").alias("_b"))
    return summaries.withColumn("_m", base).join(F.broadcast(first), "_m", "left").select("variant", "metric", "value", F.round(F.col("value") - F.coalesce("_b", F.lit(0.0)), 6).alias("delta"))
