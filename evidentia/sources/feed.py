"""Tables made from other tables, kept up to date change by change.

What changed between two versions of a table is read off their manifests: buckets with the same folder hold the same rows, and
only the others are read. A dependent table remembers, in its own manifest, the version of its source that it was made from, so
that a run which dies is made up for by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state
from .store import Catalog

#: An id that may name a stored item.
ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
MADE_FROM = "made_from"


def _digests(rows: DataFrame | None, key: list[str], name: str) -> DataFrame | None:
    """A number for the rows of each key, whatever their order."""
    if rows is None:
        return None
    rest = sorted(c for c in rows.columns if c not in key)
    return rows.groupBy(*key).agg(F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]).cast("decimal(38,0)") if rest else F.lit(0)).alias(name))


def changes(catalog: Catalog, table: str, since: int, until: int | None = None) -> DataFrame | None:
    """(key..., action: added, changed or removed) of a table kept by key, between two versions; null if the earlier one is gone or was kept
    by another key. Version 0 is the empty table. Only buckets that one of the versions wrote anew are read."""
    new = catalog._whole(table, catalog.version(table) if until is None else until)
    old = {"parts": {}, "schema": None, "key": new["key"]} if since == 0 and new else catalog._whole(table, since)
    if not new or not old or not new["key"] or old["key"] != new["key"]:
        return None
    key = new["key"]
    touched = {b for b in {*new["parts"], *old["parts"]} if new["parts"].get(b) != old["parts"].get(b)}
    b = _digests(catalog._load(new, touched), key, "new")
    a = _digests(catalog._load(old, touched), key, "old")
    both = b.withColumn("old", F.lit(None).cast("decimal(38,0)")) if a is None else b.join(a, key, "full")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(*key, action.alias("action")).filter("action is not null")


class Dependents:
    """Tables that are derived from one source table key by key: chunks, facts, vectors of files."""

    def __init__(self, catalog: Catalog, source: str, derive: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.catalog, self.source, self.derive = catalog, source, derive

    def made_from(self, table: str) -> int:
        return self.catalog.head(table)[1].get(MADE_FROM, 0)

    def refresh(self) -> dict[str, int]:
        """Brings every table to the source's last version; (table: its version). derive sees the rows of added and changed keys only,
        and buckets without such a key keep their files. Each table is one commit of its own and can be repeated."""
        now, manifest = self.catalog.head(self.source)
        done = {}
        for table, derive in self.derive.items():
            since = self.made_from(table)
            if not now or since == now:
                done[table] = self.catalog.version(table)
                continue
            done[table] = self._bring(table, derive, since, now, manifest)
        return done

    def _bring(self, table: str, derive: Callable[[DataFrame], DataFrame], since: int, now: int, manifest: dict) -> int:
        key = manifest["key"]
        found = changes(self.catalog, self.source, since, now)
        rows, held = self.catalog._load(manifest), self.catalog.read(table)
        if found is None:  # that version is gone: all keys count as changed, and what the table holds beyond them as removed
            found = rows.select(*key).distinct().withColumn("action", F.lit("changed"))
            if held is not None:
                found = found.unionByName(held.select(*key).distinct().join(rows.select(*key), key, "left_anti").withColumn("action", F.lit("removed")))
        new = derive(rows.join(found.filter("action <> 'removed'").select(*key), key, "left_semi"))
        gone = found.select(*key)
        return self.catalog.replace(table, new, key, gone, {MADE_FROM: now})


def refresh_whole(catalog: Catalog, table: str, rows: DataFrame, key: str = "path") -> int:
    """Makes a table kept by key equal to rows: keys that have vanished go, those whose rows differ are replaced, others and their files
    stay. For tables that are derived from several source rows at once, such as documents of dependencies."""
    held = catalog.read(table)
    if held is None:
        return catalog.replace(table, rows, [key], rows.select(key))
    now, old = _digests(rows, [key], "hash"), _digests(held, [key], "hash")
    actions = state.changes(now.withColumnRenamed(key, "path"), old.withColumnRenamed(key, "path")).withColumnRenamed("path", key)
    touched = actions.filter("action <> 'skip'").select(key)
    if touched.isEmpty():
        return catalog.version(table)
    return catalog.replace(table, rows.join(touched, key, "left_semi"), [key], touched)


class Sidecar:
    """A summary of each item of a table, kept beside it: made from changes, and anew only where it has drifted."""

    def __init__(self, catalog: Catalog, items: str, name: str, summarise: Callable[[DataFrame], DataFrame]) -> None:
        self.catalog, self.items, self.name, self.summarise = catalog, items, name, summarise
        self.kept = Dependents(catalog, items, {name: summarise})

    def drifted(self) -> bool:
        """Whether the summaries' keys are not those of the items."""
        items, own = self.catalog.read(self.items), self.catalog.read(self.name)
        if items is None or own is None:
            return items is not None or own is not None
        key = self.catalog.head(self.items)[1]["key"]
        a, b = items.select(*key).distinct(), own.select(*key).distinct()
        return not (a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty())

    def rebuild(self) -> int:
        now, manifest = self.catalog.head(self.items)
        rows = self.summarise(self.catalog._load(manifest))
        return self.catalog.replace(self.name, rows, manifest["key"], None, {MADE_FROM: now})

    def summaries(self, order: list[Column], limit: int = 50) -> DataFrame:
        """The first summaries in order, up to date."""
        self.kept.refresh()
        if self.drifted():
            self.rebuild()
        return self.catalog.read(self.name).orderBy(*order).limit(limit)


class Items:
    """Items (id, ...) of one kind by validated ids: the last one saved under an id is it."""

    def __init__(self, catalog: Catalog, table: str) -> None:
        self.catalog, self.table = catalog, table

    def save(self, rows: DataFrame) -> int:
        """Stores rows (id, ...), one for each id; an id that is null or not of ID's form is an error, and nothing is stored."""
        bad = rows.filter(F.col("id").isNull() | ~F.col("id").rlike(ID)).select("id").limit(3).collect()
        if bad:
            raise ValueError(f"invalid ids: {[r.id for r in bad]}")
        return self.catalog.replace(self.table, rows, ["id"], rows.select("id"))

    def remove(self, ids: DataFrame) -> int:
        held = self.catalog.read(self.table)
        return self.catalog.replace(self.table, held.limit(0), ["id"], ids.select("id")) if held is not None else 0

    def load(self, ids: DataFrame | None = None) -> DataFrame | None:
        held = self.catalog.read(self.table)
        return held if held is None or ids is None else held.join(ids.select("id").distinct(), "id", "left_semi")
