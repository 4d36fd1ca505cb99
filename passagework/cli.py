"""Commands: ask, build, eval, ablate, scan, samples, ls."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from passagework.plans import config as C
from passagework.plans.evaluate import SUITES, ablate, evaluate, save_ablation
from passagework.plans.pipeline import Pipeline, ask
from passagework.plans.registry import registry
from passagework.sources import loaders, samples
from passagework.sources.datasets import DATASETS, scan
from passagework.sources.knowledge_base import KnowledgeBase, persist_dir


def _dataset(spark, a):
    paths = {"jsonl": {"qa_path": a.qa, "corpus_path": a.corpus}, "beir_style": {"root": a.qa}}.get(a.dataset, {"path": a.qa})
    return DATASETS[a.dataset](spark, **paths, limit=a.limit)


def _pipeline(spark, a):
    C.load_dotenv()
    return Pipeline(spark, C.load(*a.config, preset=a.preset))


def _loaded(spark, a, pipeline, folder):
    if a.corpus and a.command == "ask":
        return pipeline.index(loaders.jsonl(spark, a.corpus))
    pipeline.kb = KnowledgeBase.load(spark, folder, pipeline.kb.encoder.get("object"))
    return pipeline


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="passagework")
    p.add_argument("command", choices=("ask", "build", "eval", "ablate", "scan", "samples", "ls"))
    p.add_argument("question", nargs="?")
    p.add_argument("--config", action="append", default=[])
    p.add_argument("--preset", default="default", choices=sorted(C.PRESETS))
    p.add_argument("--corpus")
    p.add_argument("--dataset", default="jsonl", choices=sorted(DATASETS))
    p.add_argument("--qa")
    p.add_argument("--limit", type=int)
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--retrieval-only", action="store_true")
    p.add_argument("--judge", action="store_true")
    p.add_argument("--reuse", action="store_true", help="evaluate on the saved knowledge base")
    p.add_argument("--rounds", type=int, default=1)
    p.add_argument("--suite", default="channel", choices=sorted(SUITES))
    p.add_argument("--out")
    a = p.parse_args(argv)
    if a.command == "ls":
        for space in registry.options():
            print(f"{space}: {', '.join(registry.options(space))}")
        return 0
    spark = spark or SparkSession.builder.appName("passagework").getOrCreate()
    if a.command == "scan":
        for path, found in scan(spark, a.question or ".").items():
            print(path, found)
        return 0
    if a.command == "samples":
        samples.write_samples(spark, a.question or "data", True)
        samples.write_tool_samples(spark, a.question or "data")
        return 0
    pipeline = _pipeline(spark, a)
    folder = persist_dir(pipeline.config)
    if a.command == "ask":
        began = time.perf_counter()
        row = ask(_loaded(spark, a, pipeline, folder), a.question or "").first()
        print(row["text"])
        print("sources:", ", ".join(map(str, row["citations"])) or "none", f"({time.perf_counter() - began:.2f} s)")
    elif a.command == "build":
        began = time.perf_counter()
        docs = _dataset(spark, a).corpus() if a.qa else loaders.jsonl(spark, a.corpus)
        pipeline.index(docs).kb.save(folder)
        n = pipeline.kb.stats().first()
        s = time.perf_counter() - began
        print(f"{n['documents']} documents, {n['chunks']} chunks, {s:.1f} s, {1000 * s / max(1, n['chunks']):.2f} ms a chunk: {folder}")
    elif a.command == "eval":
        dataset = _dataset(spark, a)
        if a.reuse:
            _loaded(spark, a, pipeline, folder)
        for _ in range(a.rounds):
            report = evaluate(pipeline, dataset, a.k, not a.retrieval_only, pipeline.llm if a.judge else None, build=not a.reuse)
        print(report.to_markdown())
        if a.out:
            report.save(a.out)
    else:
        table, skipped = ablate(spark, _dataset(spark, a), pipeline.config, a.suite, not a.retrieval_only)
        for r in table.orderBy("metric", "variant").collect():
            print(f"{r['metric']:24} {r['variant']:24} {r['value']:.4f} {r['delta']:+.4f}")
        for s in skipped:
            print("skipped", s)
        if a.out:
            save_ablation(a.out, a.suite, table, skipped)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
