"""Exact dedup: groups by a 128-bit content hash, the smallest id stays, bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Two texts are equal when their normalised bytes are. Tasks first reduce their copies to one row for each
    (hash, text), which is where bytes are compared; so a text moves once for each task that holds it and a
    group of any size costs its tasks one row each. Rows then meet their group by the hash alone, without
    texts, unless a hash has more than one text: such rows are grouped by hash and text.

    Null and empty texts are equal to each other. A null doc_id is never the smallest unless the group has no
    other, and such rows stay. Rows repeated under one doc_id are one document: they stay or go together.
    An empty table gives no rows; further columns of docs, whatever their names, are not read.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id"), text.alias("norm")).withColumn("h", content_hash(F.col("norm")))
    texts = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # written, so that both sides of the join below are plain exchanges and a hot group's rows can be split
    groups = written(by_hash, "groups")
    slim = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    out = slim.join(groups.filter("n_texts = 1"), "h").select("doc_id", "keep_id", "group_size", "text_sha256")
    if not groups.filter("n_texts > 1").isEmpty():
        split = groups.filter("n_texts > 1").select("h")
        own = written(rows.join(split, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "collisions")
        out = out.unionByName(rows.join(own, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


EXACT_DEDUP_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
k as (select doc_id, norm, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""
