"""Model calls over tables of prompts, and a durable table of their answers."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.retrieval import QUERY_ROWS

#: Prompts of a task (what a lost executor asks again, at most, for each of its cores), unless that makes more than MOST_TASKS of them.
TASK_PROMPTS, MOST_TASKS = 64, 20_000
SCHEMA = "call_key string, answer string, error string, run string"


class Rate:
    """Lets so many callers a second pass, whatever their threads; None lets all pass."""

    def __init__(self, per_second: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()
        self.clock, self.sleep = clock, sleep

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        self.sleep(at - now)


class Kept:
    """A model whose answers are kept as Parquet below path, by the hash of name, system text and prompt.

    concurrent is how many calls a task has open at a time; per_second bounds all tasks
    together: each has its share by the session's default parallelism.
    """

    def __init__(self, inner, name: str, path: str, concurrent: int = 8, per_second: float | None = None, task_prompts: int = TASK_PROMPTS):
        self.inner, self.name, self.path = inner, name, path
        self.concurrent, self.per_second, self.task_prompts = concurrent, per_second, task_prompts

    def ask(self, text: str, system: str | None = None, **options) -> str:
        """One call outside of any table; nothing is kept."""
        return self.inner.ask(text, system=system, **options)

    def chat(self, messages, **options) -> str:
        return self.inner.chat(messages, **options)

    def using(self, inner, name: str) -> Kept:
        """The same table and bounds for another service."""
        return Kept(inner, name, self.path, self.concurrent, self.per_second, self.task_prompts)


def _asking(llm, system: str | None, concurrent: int, per_second: float | None):
    """prompts to (answer, error), with so many open calls; a failed call is an error, a null prompt no call."""

    def one(prompt, rate: Rate):
        if prompt is None:
            return None, None
        rate.wait()
        try:
            return llm.ask(prompt, system=system), None
        except Exception as e:  # any failure of the service counts
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[tuple]) -> Iterator[tuple]:
        """(keys, prompts) to (keys, pairs)."""
        rate = Rate(per_second)
        with ThreadPoolExecutor(concurrent) as pool:
            for keys, prompts in batches:
                yield keys, list(pool.map(lambda p: one(p, rate), prompts))

    return run


def read_calls(spark, path: str) -> DataFrame | None:
    """What the table holds, without the files of unfinished tasks; None before the first call."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(at)):
        return None
    return spark.read.schema(SCHEMA).parquet(path)


def call_key(prompt: str, llm: Kept, system: str | None = None) -> Column:
    """The key of a prompt's call; lengths keep the three parts apart."""
    parts = (F.lit(llm.name), F.lit(system or ""), F.col(prompt))
    return F.sha2(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))), 256)


def said(rows: DataFrame, prompt: str, llm, system: str | None = None) -> DataFrame:
    """rows with answer and error of the prompts in a column; a null prompt is no call and has neither.

    With a Kept model equal prompts are one call, those the table answers none, and the
    others are asked now. Small tasks hand in their answers one by one (the committer's
    second algorithm), so answers of finished tasks stay when an executor is lost or
    the job fails. Failed calls aren't answers: the next run asks them again.
    """
    if not isinstance(llm, Kept):
        asking = _asking(llm, system, 1, None)

        @F.pandas_udf("answer string, error string")
        def asked(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for _, pairs in asking((None, p) for p in prompts):
                yield pd.DataFrame(pairs, columns=["answer", "error"])

        return rows.withColumn("_said", asked(prompt)).select(*(F.col(f"`{c}`") for c in rows.columns), "_said.answer", "_said.error")
    spark, run = rows.sparkSession, uuid.uuid4().hex
    keyed = rows.withColumn("call_key", call_key(prompt, llm, system))
    asked_for, before = keyed.where("call_key is not null"), read_calls(spark, llm.path)
    # keys alone tell what is missing; texts are only moved for those that are
    keys = asked_for.select("call_key").distinct()
    if before is not None:
        keys = keys.join(before.where("answer is not null").select("call_key"), "call_key", "left_anti")
    count = keys.count()
    if count:
        tasks = min(MOST_TASKS, -(-count // llm.task_prompts))
        share = llm.per_second / spark.sparkContext.defaultParallelism if llm.per_second else None
        asking = _asking(llm.inner, system, llm.concurrent, share)

        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for keys, pairs in asking((b["call_key"], b["prompt"]) for b in batches):
                yield pd.DataFrame({"call_key": keys, "answer": [a for a, _ in pairs], "error": [e for _, e in pairs], "run": run})

        if before is not None:
            asked_for = asked_for.join(F.broadcast(keys) if count <= QUERY_ROWS else keys, "call_key", "left_semi")
        missing = asked_for.groupBy("call_key").agg(F.first(prompt).alias("prompt"))
        asked = missing.repartition(tasks, "call_key").mapInPandas(answers, SCHEMA)
        asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(llm.path)
    held = read_calls(spark, llm.path)
    if held is None:  # there was no prompt at all
        held = spark.createDataFrame([], SCHEMA)
    # a task that was run twice may have left two answers: the least one counts for all
    held = held.where(F.col("answer").isNotNull() | (F.col("run") == run)).groupBy("call_key").agg(F.min("answer").alias("answer"), F.min("error").alias("error"))
    held = held.withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))
    return keyed.join(held, "call_key", "left").drop("call_key")
