"""Evaluation runs kept and compared: metrics by key, what each lever adds, and baselines with the conditions they were measured under."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Catalog
from . import quality

#: Leaves that have no better direction, and the number of cases by which a difference may be chance.
INFO_ONLY, NOISE_CASES = ("n", "coPerExc"), 1.25
METRICS = "key string, value double"


def case_digest(cases: DataFrame) -> str:
    """A digest of cases (type, text, expect), whatever their order: of the sorted expected paths, and of how often a case occurs."""
    one = F.xxhash64(F.coalesce("type", F.lit("")), F.coalesce("text", F.lit("")), F.array_join(F.array_sort("expect"), "\n"))
    got = cases.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("d")).first()
    return f"{got.n}:{got.d}"


def flatten(metrics: DataFrame, names: list[str], leaves: list[str]) -> DataFrame:
    """(key, value): a row for each leaf of metrics, its key the names and the leaf with points between them; nulls are left out."""
    long = metrics.unpivot([F.col(c) for c in names], [F.col(c).cast("double").alias(c) for c in leaves], "leaf", "value").filter(F.col("value").isNotNull())
    return long.select(F.concat_ws(".", *names, "leaf").alias("key"), "value")


def leave_one_out(metrics: DataFrame, full: str = "full") -> DataFrame:
    """(step, type, recall, mrr, n, recall_gain, mrr_gain) of metrics (step, type, recall, mrr, n) of the whole and of variants without one lever:
    what the lever adds to the whole, null for the whole itself. A lever that adds nothing to any type can go."""
    whole = metrics.filter(F.col("step") == full).select("type", F.col("recall").alias("r"), F.col("mrr").alias("m"))
    gain = lambda a, b: F.when(F.col("step") != full, F.round(F.col(a) - F.col(b), 4))
    return metrics.join(whole, "type").select("step", "type", "recall", "mrr", "n", gain("r", "recall").alias("recall_gain"), gain("m", "mrr").alias("mrr_gain"))


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05, gated: Column | None = None) -> DataFrame:
    """(key, base, current, delta, status) of the keys (key, value) that both have. status is info for leaves without a direction and
    keys outside gated, else ok, improved or regressed: a change counts beyond the tolerance, and beyond one case and a quarter where
    the key's own slice says by its leaf n how many it has."""
    leaf = F.substring_index("key", ".", -1)
    slice_ = F.when(F.instr("key", ".") > 0, F.regexp_replace("key", r"\.[^.]*$", "")).otherwise("")
    size = current.filter(leaf == "n").select(slice_.alias("slice"), F.col("value").alias("n")).filter("n > 0")
    rows = current.withColumn("slice", slice_).join(baseline.select("key", F.col("value").alias("base")), "key").join(size, "slice", "left")
    delta = F.round(F.col("value") - F.col("base"), 6)
    gain = F.when(leaf.isin(*quality.LOWER_BETTER), -delta).otherwise(delta)
    room = F.greatest(F.lit(tolerance), F.coalesce(NOISE_CASES / F.col("n"), F.lit(0.0)))
    free = leaf.isin(*INFO_ONLY) if gated is None else leaf.isin(*INFO_ONLY) | ~gated
    status = F.when(free, "info").when(gain < -room, "regressed").when(gain > room, "improved").otherwise("ok")
    return rows.select("key", "base", F.col("value").alias("current"), delta.alias("delta"), status.alias("status"))


class Baselines:
    """Runs and baselines as tables of a catalog, by the name of what was measured and the kind of evaluation.

    Each run is recorded whole, with its conditions, so that it can become the baseline without being made again. A comparison under other
    conditions is refused.
    """

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def _save(self, table: str, metrics: DataFrame, conditions: dict, revision: str) -> int:
        own = metrics.select(F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
        return self.catalog.replace(table, own, [], None, {"conditions": json.loads(json.dumps(conditions)), "revision": revision})

    def record(self, name: str, kind: str, metrics: DataFrame, conditions: dict, revision: str = "unknown") -> int:
        """Keeps metrics (key, value) as the last run."""
        return self._save(f"runs-{name}-{kind}", metrics, conditions, revision)

    def save(self, name: str, kind: str, metrics: DataFrame, conditions: dict, revision: str = "unknown") -> int:
        """Makes metrics (key, value) the baseline."""
        return self._save(f"baseline-{name}-{kind}", metrics, conditions, revision)

    def promote(self, name: str, kind: str) -> int:
        """Makes the last recorded run the baseline."""
        version, manifest = self.catalog.head(f"runs-{name}-{kind}")
        if not version:
            raise LookupError(f"no recorded {kind} run of {name}")
        return self.save(name, kind, self.catalog.read(f"runs-{name}-{kind}", version), manifest["conditions"], manifest["revision"])

    def mismatches(self, name: str, kind: str, conditions: dict) -> list[str]:
        """In what the baseline's conditions differ; that there is no baseline counts too."""
        version, manifest = self.catalog.head(f"baseline-{name}-{kind}")
        if not version:
            return ["no baseline"]
        old, new = manifest["conditions"], json.loads(json.dumps(conditions))
        return [f"{k}: baseline={json.dumps(old.get(k))} current={json.dumps(new.get(k))}" for k in sorted(old.keys() | new.keys()) if old.get(k) != new.get(k)]

    def compare(self, name: str, kind: str, metrics: DataFrame, conditions: dict, tolerance: float = 0.05, gated: Column | None = None) -> DataFrame:
        """compare() with the baseline; ValueError if it was measured under other conditions or is missing."""
        if wrong := self.mismatches(name, kind, conditions):
            raise ValueError("incomparable: " + "; ".join(wrong))
        return compare(metrics, self.catalog.read(f"baseline-{name}-{kind}"), tolerance, gated)
