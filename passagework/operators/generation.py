"""Context packing, generators and model calls."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import citation_numbers, index_tokens, normalize, sentences, strip
from passagework.operators.calls import Kept, said
from passagework.operators.encoding import http_detail
from passagework.operators.retrieval import top_k

# fixed values: answers without evidence, the block header, and the prompt's form
NO_EVIDENCE_EXTRACTIVE = "资料中未提及"
NO_EVIDENCE_STUFF = "资料中未提及。"
BLOCK_HEADER = "[%d] （来源：%s）\n"
USER_TEMPLATE = "【参考资料】\n{context}\n\n【问题】\n{question}\n\n【回答】"
SYSTEM_PROMPT = "Answer from the given material only. Say so if it lacks the answer. Mark the material used by its number, such as [1]. Be brief; begin with the conclusion."


def pack_contexts(hits: DataFrame, max_chars: int) -> DataFrame:
    """hits(query_id, rank, chunk_id, doc_id, text[, title]) to (query_id, context, used): numbered blocks within the budget.

    The running sum includes a block that overflows, so nothing after it fits; the
    first block is always there, cut to the budget.
    """
    title = F.coalesce(F.col("title"), F.col("doc_id").cast("string")) if "title" in hits.columns else F.col("doc_id").cast("string")
    block = F.concat(F.format_string(BLOCK_HEADER, F.col("rank"), title), F.col("text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    blocks = hits.withColumn("block", block).withColumn("cum", F.sum(F.length("block")).over(w))
    kept = blocks.where((F.col("rank") == 1) | (F.col("cum") <= max_chars)).withColumn("block", F.substring("block", 1, max_chars))
    rows = F.array_sort(F.collect_list(F.struct("rank", "block", "chunk_id")))
    return kept.groupBy("query_id").agg(rows.alias("b")).select("query_id", F.array_join("b.block", "\n\n").alias("context"), F.col("b.chunk_id").alias("used"))


def citations(answer: Column, used: Column) -> Column:
    """Chunk ids of the [n] marks that point at a used block, in order, each once."""
    in_range = F.filter(citation_numbers(answer), lambda i: (i >= 1) & (i <= F.size(used)))
    return F.array_distinct(F.transform(in_range, lambda i: F.element_at(used, i)))


def extractive(queries: DataFrame, hits: DataFrame, max_sentences: int = 2) -> DataFrame:
    """(query_id, text, citations): the sentences that cover the question best, less a penalty for length; ties by rank and position."""
    q = queries.select("query_id", F.array_distinct(index_tokens(F.col("question"))).alias("qt"))
    rows = hits.join(q, "query_id").select("query_id", "qt", "rank", "chunk_id", F.posexplode(F.transform(sentences(F.col("text")), strip)).alias("pos", "sentence"))
    rows = rows.where(F.length(normalize(F.col("sentence"))) >= 2).withColumn("st", F.array_distinct(index_tokens(F.col("sentence")))).where(F.size("st") > 0)
    score = F.size(F.array_intersect("qt", "st")) / F.greatest(F.size("qt"), F.lit(1)) - 0.0005 * F.length("sentence")
    scored = rows.select("query_id", "rank", "pos", "chunk_id", "sentence", F.round(score, 9).alias("score"))
    picked = top_k(scored.withColumnRenamed("rank", "hit_rank"), max_sentences, [F.desc("score"), F.asc("hit_rank"), F.asc("pos")])
    made = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence", "chunk_id"))).alias("s"))
    answered = made.select("query_id", F.array_join("s.sentence", " ").alias("text"), F.array_distinct("s.chunk_id").alias("citations"))
    none = F.array().cast(answered.schema["citations"].dataType)
    return queries.select("query_id").join(answered, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NO_EVIDENCE_EXTRACTIVE)).alias("text"), F.coalesce("citations", none).alias("citations"))


def prompt(context: Column, question: Column, template: str = USER_TEMPLATE) -> Column:
    parts = re.split(r"(\{context\}|\{question\})", template)
    return F.concat(*(context if p == "{context}" else question if p == "{question}" else F.lit(p) for p in parts if p))


def echo(text: Column, prefix: str = "") -> Column:
    """A stand-in for a model: the prompt's last 200 characters."""
    return F.concat(F.lit(prefix), F.right(text, F.lit(200)))


class HttpChat:
    """A chat endpoint of the common JSON form. Any error is tried again after 2^attempt seconds; options of a call override model, temperature and max_tokens."""

    def __init__(self, model: str, base_url: str, api_key: str = "", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 120, max_retries: int = 3, post=None, sleep=time.sleep):
        self.defaults = {"model": model, "temperature": temperature, "max_tokens": max_tokens}
        self.url, self.api_key, self.timeout, self.max_retries = base_url.rstrip("/") + "/chat/completions", api_key, timeout, max_retries
        self._post, self._sleep = post or self._http, sleep

    def _http(self, url: str, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def chat(self, messages: list[dict[str, str]], **options) -> str:
        error: object = None
        for attempt in range(self.max_retries):
            try:
                return self._post(self.url, {**self.defaults, **options, "messages": messages})["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                error = f"{e}: {http_detail(e)}"
            except Exception as e:  # any failure of the service counts
                error = e
            self._sleep(2**attempt)
        raise RuntimeError(f"the model call failed {self.max_retries} times: {error}")

    def ask(self, text: str, system: str | None = None, **options) -> str:
        return self.chat([*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": text}], **options)


class Echo:
    """The same as echo(), as an object with the interface of a model."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def chat(self, messages: list[dict[str, str]], **options) -> str:
        return self.prefix + (messages[-1]["content"] if messages else "")[-200:]

    def ask(self, text: str, system: str | None = None, **options) -> str:
        return self.chat([*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": text}], **options)


def stuff(queries: DataFrame, hits: DataFrame, llm, max_context_chars: int = 4000, system: str = SYSTEM_PROMPT, template: str = USER_TEMPLATE) -> DataFrame:
    """(query_id, text, citations, raw): the model's answer to packed contexts; no hits, no call. An Echo model stays native."""
    packed = queries.join(pack_contexts(hits, max_context_chars), "query_id", "left").withColumn("_p", prompt(F.col("context"), F.col("question"), template))
    if isinstance(llm, Echo):
        answered = packed.withColumn("raw", echo(F.col("_p"), llm.prefix)).withColumn("error", F.lit(None).cast("string"))
    else:
        answered = said(packed, "_p", llm, system).withColumnRenamed("answer", "raw")
    none = F.array().cast(packed.schema["used"].dataType)
    text = F.when(F.col("used").isNull(), F.lit(NO_EVIDENCE_STUFF)).otherwise(strip(F.col("raw")))
    return answered.select("query_id", text.alias("text"), F.coalesce(citations(F.col("raw"), F.col("used")), none).alias("citations"), F.coalesce("raw", F.lit("")).alias("raw"), "error")


# --- query rewriting -------------------------------------------------------

MULTI_QUERY_PROMPT = "Rewrite the question below as {n} search queries of the same meaning in other words, one a line, without numbers or remarks.\nQuestion: {q}"
HYDE_PROMPT = "Write a paragraph of about 100 words, as in an encyclopedia, that answers the question below; it need not be right.\nQuestion: {q}"


def transform_queries(queries: DataFrame, kind: str = "identity", llm=None, n: int = 3, keep_original: bool = True) -> DataFrame:
    """(query_id, variant, question): the question and its rewritings; a failed call leaves the question alone."""
    if kind == "identity":
        return queries.select("query_id", F.lit(0).alias("variant"), "question")
    template = {"multi_query": MULTI_QUERY_PROMPT, "hyde": HYDE_PROMPT}[kind]
    asked = said(queries.select("query_id", "question", prompt_of(template, F.col("question"), n).alias("_p")), "_p", llm).withColumnRenamed("answer", "_a")
    if kind == "multi_query":
        lines = F.filter(F.transform(F.split("_a", r"\R"), strip), lambda x: x != "")
        variants = F.concat(F.array("question"), F.slice(lines, 1, n))
    else:
        variants = F.concat(F.array("question"), F.array(strip(F.col("_a")))) if keep_original else F.array(strip(F.col("_a")))
    variants = F.when(F.col("_a").isNull(), F.array("question")).otherwise(variants)
    return asked.select("query_id", F.posexplode(variants).alias("variant", "question"))


def prompt_of(template: str, question: Column, n: int) -> Column:
    before, after = template.replace("{n}", str(n)).split("{q}")
    return F.concat(F.lit(before), question, F.lit(after))


# --- rerankers that call models --------------------------------------------


def _candidates(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, question, held): each query's candidates in their order; such lists are short (the retriever's k)."""
    rows = hits.select("query_id", F.struct("rank", "chunk_id", "text", "score", "source").alias("c")).groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("held"))
    return rows.join(queries.select("query_id", "question"), "query_id")


def _reordered(rows: DataFrame, order: Column, k: int, source: str) -> DataFrame:
    """The first k of each query's candidates by order, an array of (place, score); where it is null they stay as they were."""
    moved = F.transform(F.slice("order", 1, k), lambda o: F.struct(*(F.element_at("held", o["place"] + 1)[c].alias(c) for c in ("chunk_id", "text")), o["score"].alias("score"), F.lit(source).alias("source")))
    same = F.transform(F.slice("held", 1, k), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["score"].cast("double").alias("score"), c["source"].alias("source")))
    found = rows.withColumn("order", order).select("query_id", F.posexplode(F.coalesce(moved, same)).alias("n", "c"))
    return found.select("query_id", (F.col("n") + 1).alias("rank"), "c.chunk_id", "c.text", "c.score", "c.source")


#: What a reranker answers for one query.
ORDER = "array<struct<place:int,score:double>>"


def rerank_cross_encoder(queries: DataFrame, hits: DataFrame, k: int, model_name: str, batch_size: int = 16, device: str | None = None, model=None) -> DataFrame:
    """Pairs are scored by a cross-encoder (optional dependency), best first."""
    held = {"model": model}

    @F.pandas_udf(ORDER)
    def ordered(questions: pd.Series, texts: pd.Series) -> pd.Series:
        if held["model"] is None:
            from sentence_transformers import CrossEncoder  # optional

            held["model"] = CrossEncoder(model_name, device=device)
        out = []
        for q, ts in zip(questions, texts, strict=True):
            scores = map(float, held["model"].predict([(q, t) for t in ts], batch_size=batch_size))
            out.append([{"place": i, "score": s} for i, s in sorted(enumerate(scores), key=lambda p: -p[1])])
        return pd.Series(out)

    return _reordered(_candidates(hits, queries), ordered("question", F.col("held.text")), k, "rerank:cross_encoder")


def api_results(payload: dict) -> list:
    """The result list of a rerank response, in any of its three places."""
    return (payload.get("output") or {}).get("results") or payload.get("results") or payload.get("data") or []


class HttpReranker:
    """A rerank endpoint, a path below the base address; one below /services/ takes the nested body."""

    def __init__(self, model: str, base_url: str, api_key: str = "", max_chars: int = 1000, timeout: float = 60, max_retries: int = 2, endpoint: str | None = None, post=None, sleep=time.sleep):
        self.model, self.api_key, self.max_chars, self.timeout, self.max_retries = model, api_key, max_chars, timeout, max_retries
        # fixed values: the two default paths
        path = endpoint or ("/services/rerank/text-rerank/text-rerank" if "dashscope" in base_url else "/rerank")
        path = "/" + path.lstrip("/")
        self.nested, self.url = path.startswith("/services/"), base_url.rstrip("/") + path
        self._post, self._sleep = post or self._http, sleep

    _http = HttpChat._http

    def body(self, question: str, texts: list[str], k: int) -> dict:
        docs = [t[: self.max_chars] for t in texts]
        if self.nested:
            return {"model": self.model, "input": {"query": question, "documents": docs}, "parameters": {"top_n": k, "return_documents": False}}
        return {"model": self.model, "query": question, "documents": docs, "top_n": k}

    def order(self, question: str, texts: list[str], k: int):
        """(index, score) in the service's order, or None after max_retries failures or without results."""
        for attempt in range(self.max_retries):
            try:
                found = api_results(self._post(self.url, self.body(question, texts, min(k, len(texts)))))
                kept = [(int(r["index"]), float(r.get("relevance_score", r.get("score", 0.0)))) for r in found if 0 <= int(r["index"]) < len(texts)]
                return kept or None
            except Exception:
                if attempt + 1 < self.max_retries:
                    self._sleep(2**attempt)
        return None


class _Ordering:
    """A rerank endpoint with the interface of a model: a JSON request in, the order as JSON out."""

    def __init__(self, client: HttpReranker):
        self.client = client

    def ask(self, text: str, system: str | None = None) -> str:
        request = json.loads(text)
        order = self.client.order(request["question"], request["texts"], len(request["texts"]))
        if order is None:
            raise RuntimeError("the rerank service gave no results")
        return json.dumps([{"place": i, "score": s} for i, s in order])


def rerank_api(queries: DataFrame, hits: DataFrame, k: int, client: HttpReranker, calls: Kept | None = None) -> DataFrame:
    """One request for each query; without results the order stays. With calls, answers are kept in its table."""
    client_name = f"{client.url} {client.model} {client.max_chars}"
    service = calls.using(_Ordering(client), client_name) if calls else _Ordering(client)
    request = F.to_json(F.struct("question", F.col("held.text").alias("texts")))
    rows = said(_candidates(hits, queries).withColumn("_p", request), "_p", service)
    return _reordered(rows, F.from_json("answer", ORDER), k, "rerank:api")


LLM_RERANK_PROMPT = 'Rate from 0 to 10 how relevant each passage is to the question. Give a JSON array only, such as [{"id": 0, "score": 8}].\n\nQuestion: {q}\n\nPassages:\n{c}'


def parse_scores(raw: str) -> dict[int, float]:
    """Scores by id from the outermost [...] of an answer."""
    return {int(x["id"]): float(x["score"]) for x in json.loads(re.search(r"\[.*\]", raw, re.DOTALL)[0])}


def rerank_llm(queries: DataFrame, hits: DataFrame, k: int, llm, max_chars: int = 300) -> DataFrame:
    """One listwise prompt for each query; a missing id scores 0; an answer that can't be read keeps the order."""
    line = lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.substring(c["text"], 1, max_chars))
    before, between, after = re.split(r"\{q\}|\{c\}", LLM_RERANK_PROMPT)
    text = F.concat(F.lit(before), "question", F.lit(between), F.array_join(F.transform("held", line), "\n"), F.lit(after))
    rows = said(_candidates(hits, queries).withColumn("_p", text), "_p", llm)

    @F.pandas_udf(ORDER)
    def ordered(answers: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for a, n in zip(answers, counts, strict=True):
            try:
                scores = parse_scores(a)
                out.append([{"place": i, "score": scores.get(i, 0.0)} for i in sorted(range(n), key=lambda i: -scores.get(i, 0.0))])
            except Exception:
                out.append(None)
        return pd.Series(out)

    return _reordered(rows, ordered("answer", F.size("held")), k, "rerank:llm")
