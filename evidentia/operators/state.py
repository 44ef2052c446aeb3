"""State over time: latest-wins tables, change detection, caches, event logs, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in descending order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) of current (path, hash) against stored (path, hash): write_new, write_changed, skip or remove."""
    a, b = current.select("path", F.col("hash").alias("now")), stored.select("path", F.col("hash").alias("old"))
    action = F.when(F.col("old").isNull(), "write_new").when(F.col("now").isNull(), "remove").when(F.col("now") == F.col("old"), "skip").otherwise("write_changed")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def stale(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows whose key is no longer there."""
    return stored.join(current.select(key), key, "left_anti")


def younger(rows: DataFrame, ts: str, now: DataFrame, seconds: int) -> DataFrame:
    """Rows that are at most so many seconds older than now, a table of one row (now); 0 keeps all."""
    if not seconds:
        return rows
    return rows.crossJoin(F.broadcast(now)).filter(F.col(ts) >= F.col("now") - F.make_interval(secs=F.lit(seconds))).drop("now")


def apply_changes(stored: DataFrame, incoming: DataFrame, actions: DataFrame, key: str = "path") -> DataFrame:
    """stored without the removed and changed keys, and the incoming rows of the written ones."""
    gone = actions.filter(F.col("action").isin("remove", "write_changed")).select(key)
    new = actions.filter(F.col("action").startswith("write")).select(key)
    return stored.join(gone, key, "left_anti").unionByName(incoming.join(new, key, "left_semi"), allowMissingColumns=True)


def cache_hits(asks: DataFrame, answers: DataFrame, ttl_s: int) -> DataFrame:
    """(ask_id, hit) of asks (ask_id, question_hash, ts, revision): whether the cache holds an answer at that time.

    The cache holds the last of answers (answer_id, question_hash, ts, revision) to a question at or before the ask; later ones
    replace it, but one without a revision is not stored. It serves while it is younger than ttl_s (0 or less: always)
    and has the ask's revision, which is not null; an ask of another revision, or of none, removes it. Equal times
    go by the ids, answers first. Blank revisions count as null.
    """
    revision = F.when(F.trim("revision") != "", F.trim("revision")).alias("revision")
    rows = asks.select("question_hash", "ts", F.lit(1).alias("kind"), F.col("ask_id").alias("id"), revision)
    stored = answers.select("question_hash", "ts", F.lit(0).alias("kind"), F.col("answer_id").alias("id"), revision).filter("revision is not null")
    w = Window.partitionBy("question_hash").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("ts", "revision")), ignorenulls=True).over(w)
    seen = rows.unionByName(stored).withColumn("answer", last).withColumn("n", F.sum(1 - F.col("kind")).over(w))
    same = F.coalesce(F.col("revision") == F.col("answer.revision"), F.lit(False))
    before = Window.partitionBy("question_hash", "n").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when((F.col("kind") == 1) & ~same, 1).otherwise(0)).over(before), F.lit(0)) > 0
    young = F.unix_micros("ts") - F.unix_micros("answer.ts") < ttl_s * 1_000_000 if ttl_s > 0 else F.lit(True)
    return seen.withColumn("hit", same & ~gone & young).filter("kind = 1").select(F.col("id").alias("ask_id"), "hit")


def lru(accesses: DataFrame, cap: int) -> DataFrame:
    """(key, last_access, place) of the cap keys that accesses (key, ts, seq) used last."""
    last = accesses.groupBy("key").agg(F.max(F.struct("ts", "seq")).alias("m"))
    top = last.select("key", F.col("m.ts").alias("last_access"), F.col("m.seq").alias("seq")).orderBy(F.desc("last_access"), F.desc("seq")).limit(cap)
    return top.select("key", "last_access", F.row_number().over(Window.orderBy(F.desc("last_access"), F.desc("seq"))).alias("place"))


def compact(events: DataFrame, keep: list[str], merged: list[str]) -> DataFrame:
    """(trace_id, seq, type, id, payload) of events: kinds in keep stay, of those in merged each (trace, id) is one row in the
    place of its first with the payload of its last; other kinds go."""
    plain = events.filter(F.col("type").isin(*keep)).select("trace_id", "seq", "type", "id", "payload")
    one = events.filter(F.col("type").isin(*merged)).groupBy("trace_id", "type", "id").agg(F.min("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))
    return plain.unionByName(one.select("trace_id", "seq", "type", "id", "payload"))


def deltas(snapshots: DataFrame) -> DataFrame:
    """(trace_id, seq, n_before, added, final) of snapshots (trace_id, seq, items): what each has beyond the one before, holding
    back the last item until the last snapshot."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    final = F.lead("seq").over(w).isNull()
    shown = F.when(final, F.col("items")).otherwise(F.slice("items", 1, F.greatest(F.lit(0), F.size("items") - 1)))
    s = snapshots.withColumn("final", final).withColumn("shown", shown)
    before = F.coalesce(F.size(F.lag("shown").over(w)), F.lit(0))
    return s.withColumn("n_before", before).select("trace_id", "seq", "n_before", F.slice("shown", F.col("n_before") + 1, F.greatest(F.lit(0), F.size("shown") - F.col("n_before"))).alias("added"), "final")


def window_sum(rows: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """rows with (used): the sum of value over the last seconds, this row included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("used", F.round(F.sum(value).over(w), 4))


def throttle(rows: DataFrame, key: str, ts: str, least_ms: int) -> DataFrame:
    """rows that come at least least_ms behind the one before them: an approximation of an emit throttle."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("_gap", at - before).filter(F.col("_gap").isNull() | (F.col("_gap") >= least_ms * 1000)).drop("_gap")


def timer_marks(rows: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """rows with (since_start_ms, since_last_ms)."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ts, *order)
    return rows.withColumn("since_start_ms", at - F.first(at).over(w)).withColumn("since_last_ms", at - F.lag(at).over(w))


def usage(rows: DataFrame) -> DataFrame:
    """(key, input, output, total) sums of rows (key, inputTokens, promptTokens, outputTokens, completionTokens): names differ by provider."""
    zero = F.lit(0)
    i, o = F.coalesce("inputTokens", "promptTokens", zero), F.coalesce("outputTokens", "completionTokens", zero)
    return rows.groupBy("key").agg(F.sum(i).alias("input"), F.sum(o).alias("output"), F.sum(i + o).alias("total"))


def degraded(rows: DataFrame) -> DataFrame:
    """(area, n, last_at) of failures (area, ts)."""
    return rows.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


def parse_sse(frames: DataFrame) -> DataFrame:
    """(id, event, data) of frames (id, raw): event and data lines, comments skipped, data decoded as JSON; bad data is dropped."""
    line = lambda p: F.regexp_extract("raw", rf"(?m)^{p}: ?(.*)$", 1)
    parts = F.regexp_extract_all("raw", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1))
    data = F.try_parse_json(F.array_join(parts, "\n"))
    return frames.select("id", F.when(line("event") != "", line("event")).otherwise("message").alias("event"), data.alias("data")).filter("data is not null").withColumn("data", F.to_json("data"))
