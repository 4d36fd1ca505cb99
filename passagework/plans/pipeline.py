"""A retrieval pipeline from a configuration: every step maps a table of queries to a table keyed by query_id."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators import ann, block_max, calls, encoding, generation, metrics, retrieval
from passagework.plans.registry import registry
from passagework.sources import datasets, loaders
from passagework.sources.knowledge_base import KnowledgeBase, config_hash

# --- components ------------------------------------------------------------

for _kind in ("fixed", "recursive", "markdown"):
    registry.register("chunker", _kind, lambda chunk_size=400, chunk_overlap=80, min_chars=1, _k=_kind: {"kind": _k, "size": chunk_size, "overlap": chunk_overlap, "min_chars": min_chars})


@registry.register("encoder", "hashing")
def _hashing(dimension: int = 512, use_ngrams: bool = True, ngram: int = 3) -> dict:
    return {"type": "hashing", "dimension": dimension, "use_ngrams": use_ngrams, "ngram": ngram}


@registry.register("encoder", "openai_compat")
def _http_encoder(**kw) -> dict:
    return {"type": "openai_compat", "object": encoding.HttpEncoder(**kw)} | ({"dimension": kw["dimension"]} if "dimension" in kw else {})


@registry.register("encoder", "sentence_transformers")
def _local_encoder(**kw) -> dict:
    registry.need("sentence_transformers", "encoder sentence_transformers")
    return {"type": "sentence_transformers", "object": encoding.SentenceEncoder(**kw)}


@registry.register("encoder", "cached")
def _cached(inner: dict, path: str | None = None) -> dict:
    """Another encoder whose vectors are kept: in the session, and as Parquet below path if one is given."""
    return registry.build("encoder", inner) | {"cache": path or ""}


for _kind, _source in (("memory", loaders.memory), ("jsonl", loaders.jsonl), ("directory", loaders.directory)):
    registry.register("source", _kind, _source)
for _kind, _dataset in datasets.DATASETS.items():
    registry.register("dataset", _kind, _dataset)
for _kind in metrics.RETRIEVAL:
    registry.register("metric", _kind, lambda k=5, _k=_kind: lambda samples, hits, answers=None: metrics.retrieval_metrics(samples, hits, k, (_k,)))
registry.register("metric", "latency", lambda: lambda timings, n: metrics.latency(timings, n))
registry.register("metric", "context_recall", lambda: lambda samples, hits, answers=None: metrics.context_recall(samples, hits))
for _kind in ("exact_match", "answer_contains", "token_f1", "rouge_l"):
    registry.register("metric", _kind, lambda _m=getattr(metrics, _kind): lambda samples, hits, answers: _m(samples, answers))
registry.register("metric", "faithfulness", lambda: lambda samples, hits, answers: metrics.faithfulness(samples, hits, answers))
registry.register("metric", "llm_judge", lambda llm: lambda samples, hits, answers: metrics.llm_judge(samples, hits, answers, llm))
registry.register("llm", "echo", generation.Echo)
registry.register("llm", "openai_compat", generation.HttpChat)


@registry.register("llm", "kept")
def _kept(inner: dict, path: str, concurrent: int = 8, per_second: float | None = None) -> calls.Kept:
    """Another model whose answers are kept as Parquet below path, so that no answered prompt is asked again; what changes no answer isn't part of its name."""
    name = config_hash({k: v for k, v in inner.items() if k not in ("api_key", "timeout", "max_retries")})
    return calls.Kept(registry.build("llm", inner), name, path, concurrent, per_second)


@registry.register("index", "flat")
def _flat(space: str = "ip", path: str | None = None, collection: str | None = None) -> dict:
    return {"search": "exact", "space": space}


@registry.register("index", "chroma")
def _cells(space: str = "cosine", path: str | None = None, collection: str | None = None, ef_construction: int = 200, max_neighbors: int = 32, ef_search: int = 100, reset: bool = False, cells: int | None = None, rescored: int | None = None) -> dict:
    """The approximate index: cells and codes. ef_search is the number of cells that a search visits; cells, if given, their number. The settings of a graph's construction have no counterpart and are accepted."""
    return {"search": "cells", "space": space, "width": ef_search, "cells": cells, "rescored": rescored}


@registry.register("index", "lsh")
def _lsh(tables: int = 12, bits: int = 4, seed: int = 7, path: str | None = None, collection: str | None = None) -> dict:
    return {"search": "lsh", "tables": tables, "bits": bits, "seed": seed}


def _encode_queries(queries: DataFrame, kb: KnowledgeBase) -> DataFrame:
    rows = queries.select("query_id", F.col("question").alias("text"))
    e = kb.encoder
    if e["type"] != "hashing":
        return kb.encoded(rows, "query_id", is_query=True)
    return encoding.densify(encoding.hash_vectors(rows, "query_id", e["dimension"], e["use_ngrams"], e["ngram"]), "query_id", e["dimension"])


@registry.register("retriever", "vector")
def _vector(kb: KnowledgeBase, index: dict, where: dict | None = None):
    def run(queries: DataFrame, k: int) -> DataFrame:
        vectors, q = kb.chunks.where(retrieval.matches(where, kb.chunks.columns)), _encode_queries(queries, kb)
        if index["search"] == "cells":
            rows, model = kb.cells(index["space"], index["cells"])
            return ann.search(q, rows, model, k, index["width"], index["rescored"], where)
        if index["search"] == "lsh":
            return retrieval.lsh_top_k(q, vectors, k, index["tables"], index["bits"], index["seed"])
        return retrieval.dense_top_k(q, vectors, k, index["space"])

    return run


@registry.register("retriever", "bm25")
def _bm25(kb: KnowledgeBase, where: dict | None = None, k1: float = 1.5, b: float = 0.75, skip: bool = False):
    """With skip, blocks of a stored knowledge base that can't reach the best k aren't scored; the hits are the same."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        post = kb.postings if not where else kb.postings.join(kb.chunks.where(retrieval.matches(where, kb.chunks.columns)).select("chunk_id"), "chunk_id", "left_semi")
        if skip and kb.bounds is not None:
            return block_max.search(queries, post, kb.bounds, kb.term_stats, kb.corpus_stats, k, k1, b, kb.folders)[0]
        return retrieval.bm25_top_k(queries, post, kb.term_stats, kb.corpus_stats, k, k1, b, kb.folders)

    return run


@registry.register("retriever", "hybrid")
def _hybrid(channels: list, kb: KnowledgeBase, index: dict, llm=None, weights: list | None = None, rrf_k: int = 60, overfetch: float = 2.0):
    if not channels:
        raise ValueError("a hybrid retriever needs a channel")
    parts = [registry.build("retriever", c, kb=kb, index=index, llm=llm) for c in channels]

    def run(queries: DataFrame, k: int) -> DataFrame:
        n = retrieval.overfetch(k, overfetch)
        return retrieval.rrf([p(queries, n) for p in parts], k, weights, rrf_k)

    return run


@registry.register("retriever", "transformed")
def _transformed(inner: dict, kb: KnowledgeBase, index: dict, transformer: dict | str = "identity", llm=None):
    part, rewrite = registry.build("retriever", inner, kb=kb, index=index, llm=llm), registry.build("query_transformer", transformer, llm=llm)

    def run(queries: DataFrame, k: int) -> DataFrame:
        variants = rewrite(queries).withColumn("both", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("variant").cast("string")))
        hits = part(variants.select(F.col("both").alias("query_id"), "question"), k).withColumnRenamed("query_id", "both")
        return retrieval.max_merge(hits.join(variants.select("both", "query_id", "variant"), "both"), k)

    return run


registry.register("query_transformer", "identity", lambda: lambda q: generation.transform_queries(q))
registry.register("query_transformer", "multi_query", lambda llm, n=3: lambda q: generation.transform_queries(q, "multi_query", llm, n))
registry.register("query_transformer", "hyde", lambda llm, keep_original=True: lambda q: generation.transform_queries(q, "hyde", llm, keep_original=keep_original))
registry.register("reranker", "identity", lambda: lambda q, h, k: retrieval.rerank_identity(h, k))
registry.register("reranker", "lexical", lambda alpha=0.7, length_penalty=0.15: lambda q, h, k: retrieval.rerank_lexical(q, h, k, alpha, length_penalty))
@registry.register("reranker", "cross_encoder")
def _cross_encoder(model_name: str, batch_size: int = 16, device: str | None = None):
    registry.need("sentence_transformers", "reranker cross_encoder")
    return lambda q, h, k: generation.rerank_cross_encoder(q, h, k, model_name, batch_size, device)




@registry.register("reranker", "api")
def _api(llm=None, **kw):
    """Where the pipeline's model is a kept one, the service's answers go to the same table."""
    client, kept = generation.HttpReranker(**kw), llm if isinstance(llm, calls.Kept) else None
    return lambda q, h, k: generation.rerank_api(q, h, k, client, kept)


registry.register("reranker", "llm", lambda llm, max_chars=300: lambda q, h, k: generation.rerank_llm(q, h, k, llm, max_chars))
registry.register("generator", "extractive", lambda max_sentences=2: lambda q, h: generation.extractive(q, h, max_sentences))
registry.register("generator", "stuff", lambda llm, max_context_chars=4000, system_prompt=generation.SYSTEM_PROMPT, user_template=generation.USER_TEMPLATE: lambda q, h: generation.stuff(q, h, llm, max_context_chars, system_prompt, user_template))


class Pipeline:
    """index(docs), then answer(queries): candidates, reranking, generation."""

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config = spark, config
        self.llm = registry.build("llm", config["llm"])
        self.kb = KnowledgeBase(spark, registry.build("chunker", config["chunker"]), registry.build("encoder", config["encoder"]))
        self.index_spec = registry.build("index", config["index"])
        self.reranker = registry.build("reranker", config["reranker"], llm=self.llm)
        self.generator = registry.build("generator", config["generator"], llm=self.llm)
        self.timings: dict[str, float] = {}

    def index(self, docs: DataFrame) -> Pipeline:
        self.kb.add(docs)
        return self

    def set_ef_search(self, width: int) -> Pipeline:
        """From now on approximate searches visit so many cells; nothing is built again."""
        if self.index_spec["search"] == "cells":
            self.index_spec["width"] = width
        return self

    @property
    def retriever(self):
        bm25 = self.config.get("bm25", {})

        def tuned(spec):
            spec = dict(spec)
            if spec["type"] == "bm25":
                return {**bm25, **spec}
            if "channels" in spec:
                spec["channels"] = [tuned(c) for c in spec["channels"]]
            if isinstance(spec.get("inner"), dict):
                spec["inner"] = tuned(spec["inner"])
            return spec

        return registry.build("retriever", tuned(self.config["retriever"]), kb=self.kb, index=self.index_spec, llm=self.llm)

    def contexts(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, title, text, score, source)."""
        k = top_k or self.config["pipeline"]["top_k"]
        return self.reranked(queries, self.candidates(queries, k), k)

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        return self.retriever(queries, max(self.config["pipeline"]["candidate_k"], k))

    def reranked(self, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        columns = ["chunk_id", "doc_id", "text", *(c for c in ("title",) if c in self.kb.chunks.columns)]
        hits = candidates.select("query_id", "rank", "chunk_id", "score", "source").join(self.kb.chunks.select(*columns), "chunk_id")
        ranked = self.reranker(queries, hits, k)
        if "doc_id" not in ranked.columns:  # rerankers that call a service give texts back
            ranked = ranked.join(self.kb.chunks.select("chunk_id", *(c for c in columns if c not in ("chunk_id", "text"))), "chunk_id")
        return ranked

    retrieve_only = contexts

    def answer(self, queries: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(answers, contexts); contexts and answers are computed once, so that no model is asked twice."""
        k = top_k or self.config["pipeline"]["top_k"]
        candidates = self.timed("retrieve", self.candidates(queries, k))
        hits = self.timed("rerank", self.reranked(queries, candidates, k))
        answers = self.timed("generate", self.generator(queries, hits))
        self.timings["total"] = sum(self.timings[s] for s in ("retrieve", "rerank", "generate"))
        return answers, hits

    def timed(self, stage: str, df: DataFrame) -> DataFrame:
        """df computed now and kept in the checkpoint folder, so that no model is asked again when an executor is lost; its seconds go to timings."""
        began = time.perf_counter()
        df = retrieval.kept_table(df)
        self.timings[stage] = time.perf_counter() - began
        return df


def ask(pipeline: Pipeline, question: str) -> DataFrame:
    """One question, as a table of one row."""
    return pipeline.answer(pipeline.spark.createDataFrame([("q", question)], "query_id string, question string"))[0]


def rank_documents(hits: DataFrame) -> DataFrame:
    """(query_id, doc_ids): distinct documents in the order of their first chunk."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    w = Window.partitionBy("query_id").orderBy("r", "doc_id")
    return first.withColumn("n", F.row_number().over(w)).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda s: s["doc_id"]).alias("doc_ids"))
