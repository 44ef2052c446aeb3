from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import exact_dedup, sharding
from evidentia.llm.queries import SHARDS

DOCS = "doc_id long, text string, lang string, norm string, h string, keep_id long"
ROWS = [(5, "a  b", "en", "x", "y", 0), (2, "a\tb", None, None, None, None), (9, "a b", "en", "", "", 1), (7, None, "en", "", "", 1), (8, "", None, "", "", 1), (None, "lonely", "en", "", "", 1), (11, "x" * 200_000, "en", "", "", 1), (11, "x" * 200_000, "en", "", "", 1), (12, "A b", "en", "", "", 1)]


@pytest.mark.parametrize("weak", [False, True])
def test_groups_by_bytes_even_if_hashes_collide(spark, weak):
    docs = spark.createDataFrame(ROWS, DOCS)
    hash_ = (lambda c: F.substring(F.md5(c), 1, 0)) if weak else F.md5
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, hash_).collect()), key=str)
    want = sorted([(5, 2, 3, False), (2, 2, 3, True), (9, 2, 3, False), (7, 7, 2, True), (8, 7, 2, False), (None, None, 1, True), (11, 11, 2, True), (11, 11, 2, True), (12, 12, 1, True)], key=str)
    assert got == want


def test_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_lookup_table_by_its_definition():
    shards, slots = [f"s{i}" for i in range(7)], 101
    import hashlib

    order = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append([(offset + k * skip) % slots for k in range(slots)])
        assert sorted(order[-1]) == list(range(slots))
    free, want, turn = set(range(slots)), [None] * slots, 0
    while free:
        slot = next(s for s in order[turn % 7] if s in free)
        free.remove(slot)
        want[slot] = turn % 7
        turn += 1
    assert sharding.lookup_table(shards, slots) == want


def test_table_is_even_and_steady():
    table = sharding.lookup_table(SHARDS)
    counts = [table.count(i) for i in range(len(SHARDS))]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.05 * len(table)


def test_bad_tables():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_place(spark):
    docs = spark.createDataFrame([(1, "x", 3, "own"), (1, "x", 3, "own"), (None, None, None, None)], "doc_id long, text string, slot int, shard string")
    rows = sharding.place(docs, SHARDS).collect()
    assert len(rows) == 3 and rows[0] is not None
    assert all(0 <= r.slot < sharding.SLOTS and 0 <= r.shard < 64 for r in rows)
    one = [r for r in rows if r.doc_id == 1]
    assert one[0] == one[1]
    table = sharding.lookup_table(SHARDS)
    assert all(r.shard == table[r.slot] for r in rows)
    assert sharding.place(docs.filter("false"), SHARDS).count() == 0


def test_place_spreads(spark):
    rows = sharding.place(spark.range(20_000).withColumnRenamed("id", "doc_id"), SHARDS).groupBy("shard").count().collect()
    got = defaultdict(int, {r.shard: r["count"] for r in rows})
    assert len(got) == 64 and max(got.values()) < 2 * min(got.values())
