"""Queries of the kept text index and of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.store import Catalog
from ..sources.text_index import TextIndex
from .common import query, table
from .retrieval_queries import bm25_sql, questions


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """All documents as one batch; a second one changes a fifth of them and removes a seventh of the rest."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    own = TextIndex(Catalog(spark, shared_dir(spark)))
    own.apply(docs)
    own.apply(docs.filter("key % 5 = 1").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised edition"))), docs.filter("key % 7 = 3 and key % 5 <> 1").select("key"))
    return own


@query(f"""with d as (select doc_id as key, coalesce(text, '') || case when doc_id % 5 = 1 then ' revised edition' else '' end as text from documents where doc_id % 7 <> 3 or doc_id % 5 = 1),
{bm25_sql('d')} select q, key as doc_id, score, rank from bm25""")
def text_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk over what two batches have left, by the index."""
    return index(spark, sf_dir).search(questions(spark, sf_dir), 20).withColumnRenamed("key", "doc_id")


@query(f"""with d as (select doc_id as key, coalesce(text, '') || case when doc_id % 5 = 1 then ' revised edition' else '' end as text from documents where doc_id % 7 <> 3 or doc_id % 5 = 1),
{bm25_sql('d')} select q, key as doc_id, score, rank from bm25""")
def text_index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a merge."""
    own = index(spark, sf_dir)
    own.merge()
    return own.search(questions(spark, sf_dir), 20).withColumnRenamed("key", "doc_id")


@query("""with e as (select user_id, event_id, ts, event_type, round(value, 4) as value from events),
last as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from e where event_id % 3 <> 1 or user_id % 4 <> 2)
select user_id, event_id, event_type, value from last where k = 1 and not user_id % 9 = 5""")
def stored_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of events through upsert_latest, then a batch of removals: each user's last event as the store holds it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.round("value", 4).alias("value"))
    store = Catalog(spark, shared_dir(spark), buckets=16)
    order = [F.desc("ts"), F.desc("event_id")]
    store.upsert_latest("events", e.filter("event_id % 3 = 0"), ["user_id"], order)
    store.upsert_latest("events", e.filter("event_id % 3 = 2 or event_id % 3 = 1 and user_id % 4 <> 2"), ["user_id"], order)
    store.apply_batch("events", e.limit(0), "user_id", e.filter("user_id % 9 = 5").select("user_id").distinct())
    return store.read("events").select("user_id", "event_id", "event_type", "value")
