"""Evaluation of a pipeline on a dataset, reports, and one-variable-at-a-time ablations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import metrics
from passagework.plans.config import merge
from passagework.plans.pipeline import Pipeline, rank_documents
from passagework.plans.registry import registry


#: Messages a report quotes; all failures are counted.
ERRORS_SHOWN = 20


@dataclass
class Report:
    dataset: str
    scores: DataFrame
    cases: DataFrame
    summary: dict[str, float]
    config: dict
    n: int = 0
    errors: list[str] = field(default_factory=list)
    failed: int = 0

    def to_markdown(self) -> str:
        lines = [f"# {self.dataset}", "", f"{self.n} samples, {self.failed} failed", "", "| metric | value |", "| --- | --- |"]
        lines += [f"| {k} | {v:.4f} |" for k, v in sorted(self.summary.items())]
        return "\n".join([*lines, *(f"- {e}" for e in self.errors[:3])])

    def save(self, path: str) -> None:
        """The summary and configuration as JSON; cases, one row a sample, as a JSON folder beside it."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({"dataset": self.dataset, "summary": self.summary, "config": self.config, "errors": self.errors, "failed": self.failed, "samples": self.n}, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
        self.cases.write.mode("overwrite").json(path.removesuffix(".json") + "_cases")


#: Metrics that need an answer to compare, or to judge.
OF_ANSWERS = ("exact_match", "answer_contains", "token_f1", "rouge_l", "faithfulness", "llm_judge")


def default_metrics(k: int = 5, judge=None, generate: bool = True) -> dict:
    """Name and function (samples, hits, answers) of the registered metrics; latency is taken from timings."""
    names = [*metrics.RETRIEVAL, "context_recall", *(n for n in OF_ANSWERS if generate and (n != "llm_judge" or judge is not None))]
    return {n: registry.build("metric", {"type": n} | ({"k": k} if n in metrics.RETRIEVAL else {}), llm=judge) for n in names}


def evaluate(pipeline: Pipeline, dataset, k: int = 5, generate: bool = True, judge=None, build: bool = True, metric_set: dict | None = None) -> Report:
    """Index (unless a knowledge base is there), answer all samples as one batch, score, average.

    Metrics of answers are skipped if nothing is generated; a metric only counts for
    samples that have what it needs. metric_set, if given, takes the place of
    default_metrics(); a metric that fails goes to the report's errors.
    """
    if build:
        pipeline.index(dataset.corpus())
    samples = dataset.samples().select("sample_id", "question", "answers", "gold_doc_ids").persist()
    n = samples.count()
    queries = samples.select(F.col("sample_id").alias("query_id"), "question")
    candidates = pipeline.timed("retrieve", pipeline.candidates(queries, k))
    hits = pipeline.timed("rerank", pipeline.reranked(queries, candidates, k))
    by_sample = hits.withColumnRenamed("query_id", "sample_id")
    answers, errors, failed = None, [], 0
    if generate:
        answers = pipeline.timed("generate", pipeline.generator(queries, hits).withColumnRenamed("query_id", "sample_id"))
        if "error" in answers.columns:
            wrong = answers.where("error is not null")
            failed = wrong.count()
            errors = [r[0] for r in wrong.orderBy("sample_id").select("error").limit(ERRORS_SHOWN).collect()]
    pipeline.timings["total"] = sum(pipeline.timings[s] for s in ("retrieve", "rerank", "generate") if s in pipeline.timings)
    scores = None
    for name, metric in (default_metrics(k, judge, generate) if metric_set is None else metric_set).items():
        try:
            part = pipeline.timed("judge" if name == "llm_judge" else "score", metric(samples, by_sample, answers))
        except Exception as e:  # noqa: BLE001  a metric that fails is told, the others count
            errors.append(f"{name}: {str(e).splitlines()[0][:300] if str(e) else type(e).__name__}")
            continue
        scores = part if scores is None else scores.unionByName(part)
    if scores is None:
        scores = samples.sparkSession.createDataFrame([], "sample_id string, metric string, value double")
    found = {r["metric"]: r["value"] for r in metrics.summary(scores).collect()}
    spent = {s: pipeline.timings[s] for s in ("retrieve", "rerank", "generate", "total") if s in pipeline.timings}
    found |= registry.build("metric", "latency")(spent, n)
    docs = rank_documents(hits).withColumnRenamed("query_id", "sample_id").withColumnRenamed("doc_ids", "retrieved_doc_ids")
    per = scores.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("scores"))
    cases = samples.join(docs, "sample_id", "left").join(per, "sample_id", "left")
    if answers is not None:
        cases = cases.join(answers.select("sample_id", F.col("text").alias("prediction"), "citations"), "sample_id", "left")
    return Report(dataset.name, scores, cases, found, pipeline.config, n, errors, failed)


def _chunks(size: int, overlap: int) -> dict:
    return {"chunker": {"type": "recursive", "chunk_size": size, "chunk_overlap": overlap}}


def _only(kind: str) -> dict:
    return {"retriever": {"type": kind}}


#: suite -> variant -> patch; the first variant is the baseline.
SUITES = {
    "chunk_size": {"200": _chunks(200, 40), "400": _chunks(400, 80), "800": _chunks(800, 160)},
    "channel": {"vector": _only("vector"), "bm25": _only("bm25"), "hybrid": {"retriever": {"type": "hybrid", "rrf_k": 60, "channels": [{"type": "vector"}, {"type": "bm25"}]}}},
    "rerank": {"identity": {"reranker": {"type": "identity"}}, "lexical": {"reranker": {"type": "lexical"}}, "lexical coverage only": {"reranker": {"type": "lexical", "alpha": 1.0}}},
    "index": {"exact": {"index": {"type": "flat", "space": "cosine"}, "reranker": {"type": "identity"}}, "cells": {"index": {"type": "chroma", "space": "cosine", "ef_search": 8}, "reranker": {"type": "identity"}}},
    "space": {s: {"index": {"type": "flat", "space": s}, "reranker": {"type": "identity"}} for s in ("cosine", "l2", "ip")},
    "ann_build": {str(c): {"index": {"type": "chroma", "cells": c, "ef_search": 4}, "reranker": {"type": "identity"}} for c in (8, 32, 128)},
    "ann_search": {str(w): {"index": {"type": "chroma", "cells": 32, "ef_search": w}, "reranker": {"type": "identity"}} for w in (1, 8, 32)},
    "top_k": {str(k): {"pipeline": {"top_k": k}} for k in (3, 5, 10)},
}


def ablation_markdown(suite: str, rows: DataFrame, skipped: list[str]) -> str:
    """A table of variants and metrics, each value with its difference from the baseline."""
    held: dict[str, dict[str, str]] = {}
    for r in rows.orderBy("metric").collect():  # a few rows for each variant
        held.setdefault(r["variant"], {})[r["metric"].split("@")[0]] = f"{r['value']:.4f} ({r['delta']:+.4f})"
    names = sorted({m for v in held.values() for m in v})
    variants = [v for v in SUITES[suite] if v in held]
    lines = [f"# {suite}", "", "| variant | " + " | ".join(names) + " |", "| --- " * (len(names) + 1) + "|"]
    lines += ["| " + " | ".join([v, *(held[v].get(n, "") for n in names)]) + " |" for v in variants]
    return "\n".join([*lines, *(f"- skipped: {s}" for s in skipped)]) + "\n"


def save_ablation(path: str, suite: str, rows: DataFrame, skipped: list[str]) -> None:
    """<suite>.json with all rows and <suite>.md in a folder on the driver."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    table = [r.asDict() for r in rows.orderBy("variant", "metric").collect()]
    (folder / f"{suite}.json").write_text(json.dumps({"suite": suite, "rows": table, "skipped": skipped}, ensure_ascii=False, indent=1), encoding="utf-8")
    (folder / f"{suite}.md").write_text(ablation_markdown(suite, rows, skipped), encoding="utf-8")


def ablate(spark, dataset, base: dict, suite: str, generate: bool = False) -> tuple[DataFrame, list[str]]:
    """((variant, metric, value, delta), skipped variants). Variants with the same chunker and encoder share one knowledge base."""
    shared: dict[str, object] = {}
    summaries, skipped, first = None, [], None
    for name, patch in SUITES[suite].items():
        config = merge(base, patch)
        try:
            pipeline = Pipeline(spark, config)
            key = json.dumps([config["chunker"], config["encoder"]], sort_keys=True)
            if key in shared:
                pipeline.kb = shared[key]
            else:
                pipeline.index(dataset.corpus())
                pipeline.kb.chunks = pipeline.kb.chunks.persist()
                shared[key] = pipeline.kb.index()
            report = evaluate(pipeline, dataset, config["pipeline"]["top_k"], generate, build=False)
        except (KeyError, TypeError, ValueError, ImportError) as e:
            skipped.append(f"{name}: {e}")
            continue
        rows = spark.createDataFrame([(name, m, float(v)) for m, v in report.summary.items()], "variant string, metric string, value double")
        first = first or name
        summaries = rows if summaries is None else summaries.unionByName(rows)
    return metrics.delta(summaries, first), skipped
