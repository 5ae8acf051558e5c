"""Sharding by longest-processing-time scheduling: groups that must stay together, by size.

Rows of equal text are one group. Groups go, the largest first, to the shard of least load, which a
heap gives. The schedule needs sizes only, so the instance is a histogram: groups per size class,
with one class per size below ``EXACT`` and at most ``EXACT`` classes per power of two above it:
some 300,000 entries for sizes up to 2^48 bytes, whatever the number of rows. Groups of equal size
are dealt a run at a time: shards fill up to one level at once and the heap deals the rest, as it
would have dealt them one by one.

Classes of ``EXACT`` and above are dealt by their mean size first. The true loads are then summed,
and the exact classes level out what the means left. Groups find their shard by their rank in their
class, counted in buckets of about ``ROWS_PER_BUCKET`` groups. A group of any number of copies
reaches its rows by broadcast if it is among the ``HOT`` largest, else by a shuffle that it can't
skew. A group larger than an even share makes its shard larger: it stays together.

Null texts have no bytes and are of one group with empty texts. Long texts are hashed whole (SHA-256)
and not moved. Repeated rows, and rows that share or lack a doc_id, are rows of their own. Groups of
equal size are taken in the order of their hash, shards of equal load in the order of their number.
An empty table gives no rows. Columns of the input other than doc_id and text play no part.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.operators.joins import lookup_join
from boxstats.storage import materialize

SHARDS, ROW_BYTES, LAW = 40, 16, "bytes"
#: Sizes below it are classes of their own.
EXACT = 1 << 13
ROWS_PER_BUCKET = 5_000
#: Groups whose shard reaches their rows by broadcast (32-byte keys).
HOT = 1000
BROADCAST_ROWS = 100_000
_RESERVED = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def level(loads: list[int], size: int, count: int) -> int:
    """The highest load such that filling every shard up to it takes at most ``count`` items."""
    low, high = min(loads) - 1, min(loads) + size * count
    while low < high:
        middle = (low + high + 1) // 2
        taken = sum((middle - x) // size + 1 for x in loads if x <= middle)
        low, high = (middle, high) if taken <= count else (low, middle - 1)
    return low


def longest_first(classes: list[tuple[int, int, int]], loads: list[int]) -> list[tuple[int, int, list[int], list[int]]]:
    """(class, groups, bytes) and the loads of shards -> (class, groups, ends, shards): the groups of
    a class with ranks below ends[0] go to shards[0], the next ones below ends[1] to shards[1], ..."""
    plan = []
    heap = [(x, s) for s, x in enumerate(loads)]
    for name, count, total in sorted(classes, reverse=True):
        size = max(total // count, 1)
        taken = [0] * len(loads)
        left = count
        if left > len(loads):
            loads = [x for x, _ in sorted(heap, key=lambda e: e[1])]
            top = level(loads, size, left)
            taken = [max((top - x) // size + 1, 0) if x <= top else 0 for x in loads]
            left -= sum(taken)
            heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(loads, taken))]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        ends, shards, upto = [], [], 0
        for s, k in enumerate(taken):
            if k:
                upto += k
                ends.append(upto)
                shards.append(s)
        plan.append((name, count, ends, shards))
    return plan


def _class(size):
    """The size itself below EXACT, else the size with all but its first 14 bits cleared."""
    cut = F.length(F.bin(size)) - (EXACT.bit_length())
    cleared = F.call_function("shiftleft", F.call_function("shiftright", size, cut.cast("int")), cut.cast("int"))
    return F.when(size < EXACT, size).otherwise(cleared)


def _deal(groups: DataFrame, classes: list, loads: list[int]) -> DataFrame:
    """Groups of the classes with their shard."""
    spark = groups.sparkSession
    plan = [(name, count, count // ROWS_PER_BUCKET + 1, ends, shards) for name, count, ends, shards in longest_first(classes, loads)]
    table = spark.createDataFrame(plan, "_class long, _of long, _buckets long, _ends array<long>, _shards array<int>")
    if len(plan) > BROADCAST_ROWS:
        table = materialize(table)
    names = table.select("_class", "_buckets")
    rows = lookup_join(groups, names, ["_class"], table_rows=len(plan))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_key"), F.col("_buckets")))
    sums = rows.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    # The plan meets the sums of buckets, which no class can crowd, and both meet the groups.
    facts = lookup_join(sums, table.select("_class", "_ends", "_shards"), ["_class"], table_rows=len(plan))
    inside = Window.partitionBy("_class", "_b").orderBy("_key")
    rows = rows.join(facts, ["_class", "_b"]).withColumn("_rank", F.col("_ahead") + F.row_number().over(inside) - 1)
    place = F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))
    return rows.select("_key", "_copies", "_bytes", F.element_at("_shards", place + 1).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text -> doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and the columns in ``carry``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if taken := [c for c in carry if c in _RESERVED or c.startswith("_")]:
        raise ValueError(f"columns in the way of results: {taken}")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_key"), F.monotonically_increasing_id().alias("_row"), *carry,
        )
    )
    groups = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"), F.sum("size").alias("_bytes"))
    groups = materialize(groups.withColumn("_class", _class(F.col("_bytes"))))
    found = groups.groupBy("_class").agg(F.count(F.lit(1)), F.sum("_bytes")).collect()
    classes = [tuple(map(int, r)) for r in found]
    loads = [0] * shards
    large = [c for c in classes if c[0] >= EXACT]
    parts = []
    if large:
        parts.append(materialize(_deal(groups.filter(F.col("_class") >= EXACT), large, loads)))
        for s, x in parts[0].groupBy("shard").agg(F.sum("_bytes")).collect():
            loads[s] = int(x)
    parts.append(materialize(_deal(groups.filter(F.col("_class") < EXACT), [c for c in classes if c[0] < EXACT], loads)))
    placed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    hot = placed.filter("_copies > 1").orderBy(F.desc("_copies"), "_key").limit(HOT).select("_key", "shard")
    rest = rows.join(F.broadcast(hot.select("_key")), "_key", "left_anti").join(placed.select("_key", "shard"), "_key")
    dealt = materialize(rows.join(F.broadcast(hot), "_key").unionByName(rest).drop("_key"))
    return _slots(dealt, sum(c[1] for c in classes), shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *carry
    )


def _slots(dealt: DataFrame, groups: int, shards: int) -> DataFrame:
    """Rows numbered within their shard: running sums over buckets, then within a bucket."""
    n = dealt.count()
    buckets = n // (shards * ROWS_PER_BUCKET) + 1
    rows = dealt.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sums = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("shard", "_b").orderBy("_row")
    sums = F.broadcast(sums) if shards * buckets <= BROADCAST_ROWS else sums
    return rows.join(sums, ["shard", "_b"]).withColumn("slot", (F.col("_ahead") + F.row_number().over(inside) - 1).cast("long"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder a shard, ``shard=N``, with its rows in the order of their slots in each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
