"""Registration of queries, and the tables that stand for the engine's own in them.

A query and its SQL are written side by side. The SQL blocks of FILES and so on are common table expressions in
DuckDB's dialect for the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: File types that stand for languages, so that documents spread over all kinds of files.
TYPES = ("py", "js", "md", "json", "css", "html", "go", "txt")


def file_path(doc_id: Column, source: Column, lang: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (doc_id % len(TYPES) + 1).cast("int"))
    return F.concat_ws("", source, F.lit("/"), lang, F.lit("/"), doc_id.cast("string"), F.lit("."), kind)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: (doc_id, path, content)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", file_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


FILES = """files as (
  select doc_id, concat(source, '/', lang, '/', doc_id, '.', (['py','js','md','json','css','html','go','txt'])[doc_id % 8 + 1]) as path, coalesce(text, '') as content
  from documents)"""
