"""Document sources: functions that give documents(doc_id, text, title, metadata, doc_ord)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "doc_id string, text string, metadata map<string,string>"


def memory(spark: SparkSession, documents: Iterable[tuple]) -> DataFrame:
    """(doc_id, text, metadata) rows."""
    rows = [(str(d[0]), d[1], {k: None if v is None else str(v) for k, v in (d[2] if len(d) > 2 and d[2] else {}).items()}) for d in documents]
    return _titled(spark.createDataFrame(rows, DOCUMENTS)).withColumn("doc_ord", F.monotonically_increasing_id())


def _titled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", F.coalesce(F.try_element_at("metadata", F.lit("title")), F.col("doc_id")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_ord, value): lines with their number in the file order; only \\n ends a line."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    counted = lines.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("c"))
    start = counted.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("start"))  # a row for each partition
    at = lines.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(start), "p")
    return at.select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("doc_ord"), "value")


def jsonl(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", title_field: str = "title") -> DataFrame:
    """One JSON object a line. Blank lines and rows without text are left out; a missing id is the line's number; other fields are metadata."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("m", F.from_json("value", "map<string,string>"))
    get = lambda name: F.try_element_at("m", F.lit(name))
    rest = F.map_filter("m", lambda k, v: ~k.isin(id_field, text_field, title_field))
    title = F.when(get(title_field).isNotNull(), F.create_map(F.lit("title"), get(title_field))).otherwise(F.create_map().cast("map<string,string>"))
    docs = rows.where(F.length(get(text_field)) > 0).select(F.coalesce(get(id_field), F.col("doc_ord").cast("string")).alias("doc_id"), get(text_field).alias("text"), F.map_concat(rest, title).alias("metadata"), "doc_ord")
    return _titled(docs)


def directory(spark: SparkSession, path: str, patterns: Sequence[str] = ("*.txt", "*.md"), encoding: str = "utf-8") -> DataFrame:
    """Text files below a folder: the id is the path below it and their order, the title the name without suffix; undecodable bytes are left out."""

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode(encoding, "ignore"))

    found = None
    for pattern in patterns:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
        found = part if found is None else found.unionByName(part)
    found = found.dropDuplicates(["path"])
    root = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    base = _common_root(path, root)
    name = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^\w+:/*", "/")
    relative = F.substring(name, len(base) + 1, 1 << 30)
    docs = found.select(F.regexp_replace(relative, "^/+", "").alias("doc_id"), decoded("content").alias("text"))
    stem = F.regexp_replace(F.regexp_extract("doc_id", r"([^/]*)$", 1), r"\.[^.]*$", "")
    kept = docs.where(F.col("text").rlike(r"(?U)\S")).withColumn("metadata", F.create_map(F.lit("title"), stem, F.lit("path"), F.col("doc_id")))
    # documents are in the order of their ids; no number is needed for that, and none that only one task could give
    return _titled(kept).withColumn("doc_ord", F.col("doc_id"))


def _common_root(path: str, files: Sequence[str]) -> str:
    import re
    from urllib.parse import unquote

    plain = re.sub(r"^\w+:/*", "/", path) if re.match(r"^\w+:/", path) else path
    if not plain.startswith("/") and files:
        full = re.sub(r"^\w+:/*", "/", unquote(files[0]))
        return full[: full.find(plain) + len(plain)] if plain in full else ""
    return plain.rstrip("/")


METADATA_SCALARS = (T.StringType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


def scalar_metadata(docs: DataFrame, max_chars: int = 500) -> DataFrame:
    """docs with scalar columns only: lists are joined by ", " and cut, anything else nested is dropped."""
    columns = []
    for field in docs.schema:
        if isinstance(field.dataType, METADATA_SCALARS):
            columns.append(F.col(f"`{field.name}`"))
        elif isinstance(field.dataType, T.ArrayType):
            columns.append(F.substring(F.array_join(F.transform(f"`{field.name}`", lambda x: x.cast("string")), ", "), 1, max_chars).alias(field.name))
    return docs.select(*columns)
