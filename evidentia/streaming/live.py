"""Structured Streaming: incremental indexing from file events, event logs, budgets and rolling windows."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Files that change what may be indexed at all.
POLICY = r"(^|/)\.(gitignore|ignore|indexignore)$"


def coalesce_events(events: DataFrame) -> DataFrame:
    """(path, kind) of a batch of events (seq, path, kind): the last kind of each path; an ignore file's is `policy`."""
    last = events.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))
    return last.select("path", F.when(F.col("path").rlike(POLICY), "policy").otherwise(F.col("kind")).alias("kind"))


def watch(events: DataFrame, index: Callable[[DataFrame, int], None], reindex: Callable[[int], None], checkpoint: str, every: str = "250 milliseconds") -> StreamingQuery:
    """Runs index on each batch's coalesced events, or reindex when an ignore file is among them. A path is in one batch at a time,
    and events that come meanwhile wait for the next; after a crash the last batch runs again, so both must be idempotent."""

    def run(batch: DataFrame, number: int) -> None:
        merged = coalesce_events(batch).persist()
        try:
            if merged.filter("kind = 'policy'").isEmpty():
                index(merged, number)
            else:
                reindex(number)
        finally:
            merged.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def rolling_usage(events: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(key, window, used): sums over sliding windows of event time; rows later than late are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.sum(value).alias("used"))


def first_seen(events: DataFrame, ts: str, key: list[str], ttl: str = "30 days") -> DataFrame:
    """Each key's first row within ttl."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def quiet(events: DataFrame, ts: str, key: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, fired_at): once for each burst of a key's events, seconds behind its last one. Events that are no farther apart are one burst;
    it fires when event time has passed its end. A key's state is the time of its last event."""

    def step(k: tuple, frames, held: GroupState):  # noqa: ANN001, ANN202
        rest = pd.Timedelta(seconds=seconds)
        if held.hasTimedOut:
            last = pd.Timestamp(held.get[0], unit="us")
            held.remove()
            yield pd.DataFrame([(k[0], last + rest)], columns=["key", "fired_at"])
            return
        times = sorted(t for frame in frames for t in frame[ts])
        last = pd.Timestamp(held.get[0], unit="us") if held.exists else None
        fired = []
        for t in times:
            if last is not None and t - last > rest:
                fired.append((k[0], last + rest))
            last = t if last is None else max(last, t)
        held.update((int(last.value // 1000),))
        held.setTimeoutTimestamp(max(int((last + rest).value // 1_000_000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(fired, columns=["key", "fired_at"])

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, "key string, fired_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def compact_when_quiet(events: DataFrame, ts: str, key: str, seconds: int, compact: Callable[[str], None], checkpoint: str, available: bool = False) -> StreamingQuery:
    """Runs compact for each table (key) whose events have been quiet. Batches follow one another, so that one compaction of a table is at
    work and what fires meanwhile waits as one for the next; a compaction that fails is left to the next burst."""

    def run(batch: DataFrame, number: int) -> None:
        for table in [r.key for r in batch.select("key").distinct().orderBy("key").collect()]:  # names of tables
            try:
                compact(table)
            except Exception:  # noqa: BLE001  searches work on what is not compacted
                logging.getLogger(__name__).warning("compaction of %s failed", table, exc_info=True)

    writer = quiet(events, ts, key, seconds).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


GOVERNED = "key string, ts timestamp, tokens long, admitted boolean, used long"


def govern(requests: DataFrame, budget: int, seconds: int = 60) -> DataFrame:
    """GOVERNED for requests (key, ts, tokens): a request is admitted when it fits the budget of the last seconds, or when nothing is
    used. A key's state is the admitted requests of its window, so it is bounded by the budget."""

    def step(key: tuple, frames, state: GroupState):  # noqa: ANN001, ANN202
        held: list[tuple[int, int]] = list(zip(state.get[0], state.get[1], strict=True)) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, tokens in zip(rows["ts"], rows["tokens"], strict=True):
            now = int(ts.value // 1000)
            held = [(t, n) for t, n in held if t > now - seconds * 1_000_000]
            used = sum(n for _, n in held)
            ok = used == 0 or used + tokens <= budget
            if ok:
                held.append((now, int(tokens)))
            out.append((key[0], ts, int(tokens), ok, used))
        state.update(([t for t, _ in held], [n for _, n in held]))
        yield pd.DataFrame(out, columns=["key", "ts", "tokens", "admitted", "used"])

    return requests.groupBy("key").applyInPandasWithState(step, GOVERNED, "at array<long>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def latest_table(events: DataFrame, apply: Callable[[DataFrame, int], None], key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Hands each batch's last row of each key to apply, such as Catalog.upsert_latest."""

    def run(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        apply(batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*"), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
