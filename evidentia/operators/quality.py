"""Retrieval quality: first hits, recall and reciprocal rank, ladders, and gates against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(q, type, rank) of each case: the rank of its first expected path in results (q, rank, path), null without."""
    hit = results.join(expected.select("q", F.explode("expect").alias("path")).distinct(), ["q", "path"]).groupBy("q").agg(F.min("rank").alias("rank"))
    return expected.select("q", "type").join(hit, "q", "left")


def recall_mrr(hits: DataFrame) -> DataFrame:
    """(type, recall, mrr, n) with a row `all`."""
    found, inverse = F.col("rank").isNotNull().cast("double"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    rows = hits.rollup("type").agg(F.grouping("type").alias("g"), F.round(F.avg(found), 4).alias("recall"), F.round(F.avg(inverse), 4).alias("mrr"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("type"), "recall", "mrr", "n")


def ladder(metrics: DataFrame, order: list[str]) -> DataFrame:
    """metrics (step, type, recall, mrr) with the change against the step before in order."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("step"))
    w = Window.partitionBy("type").orderBy("at")
    return metrics.withColumn("at", at).select("step", "type", "recall", "mrr", F.round(F.col("recall") - F.lag("recall").over(w), 4).alias("recall_delta"), F.round(F.col("mrr") - F.lag("mrr").over(w), 4).alias("mrr_delta"))


def dup_share(notes: DataFrame) -> DataFrame:
    """(dup_share, n) of notes (note): the share of those whose text occurs more than once, whatever its case and digits."""
    k = notes.groupBy(F.lower(F.trim(F.regexp_replace("note", "[0-9]+", "#"))).alias("key")).agg(F.count(F.lit(1)).alias("k"))
    return k.agg(F.round(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k"), 4).alias("dup_share"), F.sum("k").alias("n"))


LOWER_BETTER = ("gap", "err", "weakCallouts", "dupCo")


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05, least: int = 5) -> DataFrame:
    """(key, baseline, current, delta, verdict) of (key, value, n) rows: a change counts beyond the larger of the
    tolerance and one and a quarter cases; slices of fewer cases than least never regress."""
    both = current.join(baseline.select("key", F.col("value").alias("baseline")), "key", "full_outer")
    delta = F.round(F.col("value") - F.col("baseline"), 6)
    gain = F.when(F.element_at(F.split("key", "[.]"), -1).isin(*LOWER_BETTER), -delta).otherwise(delta)
    room = F.greatest(F.lit(tolerance), 1.25 / F.col("n"))
    verdict = F.when(F.col("value").isNull() | F.col("baseline").isNull(), "missing").when(F.col("n") < least, "small").when(gain < -room, "regressed").when(gain > room, "improved").otherwise("ok")
    return both.select("key", "baseline", F.col("value").alias("current"), delta.alias("delta"), verdict.alias("verdict"))


def percentiles(rows: DataFrame, part: list[str], value: str, points: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """(part..., n, p50..., most): values at the floor of (n - 1) * p in order, as windows, so that a group of any size streams."""
    w = Window.partitionBy(*part)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda p: F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * p) + 1, F.col(value)))
    return numbered.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), *[at(p).alias(f"p{round(p * 100)}") for p in points], F.max(value).alias("most"))
