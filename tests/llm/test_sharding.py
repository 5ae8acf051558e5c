import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import pytest

from boxstats.llm import sharding
from tests.llm.data import documents, frame


def longest_first_one_by_one(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_runs_of_equal_sizes_are_dealt_as_the_heap_deals_them(shards):
    classes = [(900, 2, 1800), (70, 1, 70), (50, 40, 2000), (7, 300, 2100), (1, 5, 5)]
    plan = sharding.longest_first(classes, [0] * shards)
    loads = [0] * shards
    for size, count, ends, owners in plan:
        for s, low, high in zip(owners, [0, *ends], ends):
            loads[s] += size * (high - low)
        assert ends[-1] == count
    assert sorted(loads) == longest_first_one_by_one([s for s, n, _ in classes for _ in range(n)], shards)


@pytest.mark.parametrize("shards, bucket", [(5, 5000), (40, 3)])
def test_shards_equal_brute_force(spark, monkeypatch, shards, bucket):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(sharding, "HOT", 2)
    rows = documents() + [(5000 + i, "hot text", "en", "s1", None) for i in range(70)] + [(None, "hot text", "en", "s1", None)] * 3
    got = sharding.shard(frame(spark, rows, clash=True), shards, carry=("lang", "text")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    where, groups, loads, slots = defaultdict(set), Counter(), Counter(), defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        where[hashlib.md5(raw).digest()].add(r.shard)
        groups[raw] += r.size
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values()) and set(loads) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Sizes beyond EXACT are dealt by their class, here one group each, so the schedule is the exact one.
    assert sorted(loads.values()) == longest_first_one_by_one(groups.values(), shards)


def test_large_classes_leave_even_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 32)
    rows = [(i, "x" * (i * 37 % 900) + str(i), "en", "s1", None) for i in range(800)]
    loads = Counter()
    for r in sharding.shard(frame(spark, rows), 6).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < sum(loads.values()) / 6 * 0.03


def test_empty_table_bad_arguments_and_files(spark, tmp_path):
    assert sharding.shard(frame(spark, documents()).limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, documents()), 0)
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, documents(), clash=True), carry=("size",))
    sharding.write(sharding.shard(frame(spark, documents()), 3, carry=("text",)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(documents()) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
