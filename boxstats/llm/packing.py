"""Best-fit packing of token pieces into sequences after Martello-Toth dominance reduction.

The packing depends on piece lengths alone, and there are at most ``capacity`` of them. So the
instance is a histogram: one count per length, whatever the number of documents. The reduction
fixes sets of one or two lengths that dominate every other set with the same longest piece, in as
many copies as there are; best-fit decreasing packs the rest, all equal bins and all equal lengths
at once. The resulting patterns go back to the pieces by the rank of each piece among those of its
length, which buckets of bounded size number without one task per length.

Null and empty texts are their end id alone. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.llm.text import runs
from boxstats.llm.tokens import WORD_TOKENIZER, tokenizer_path, word_ids
from boxstats.storage import materialize

CAPACITY, END_ID = 4096, 1
ROWS_PER_BUCKET = 20_000

Pattern = list[tuple[int, int]]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """doc_id, text -> doc_id, piece, start, length, ids_crc32: longer documents are cut."""

    def work(batches):
        encoder = word_ids(path)
        for whole in batches:
            for batch in runs(whole):
                ids, offsets = encoder.encode(batch.column("text"), end)
                ids = ids.astype("<u4")
                size = np.diff(offsets)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                at = offsets[row] + start
                body = memoryview(ids)
                crc = [zlib.crc32(body[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets and takes them out of ``count`` (indexed by length).

    For the longest piece and the room it leaves: nothing fits, so it stays alone; one piece fills
    the room exactly; no two pieces fit together; or no three fit and the best single piece is no
    shorter than any two that fit. In the last three cases the longest fitting piece belongs to it,
    since whatever else could take its place fits where that piece would have gone.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while count[length]:
                room = capacity - length
                count[length] -= 1
                present = np.flatnonzero(count[: room + 1])
                count[length] += 1
                if not len(present):
                    fixed.append(([(length, 1)], int(count[length])))
                    count[length] = 0
                    changed = True
                    break
                mate = int(present[-1])
                if mate != room and not _single_dominates(count, length, present, mate, room):
                    break
                times = int(count[length]) // 2 if mate == length else int(min(count[length], count[mate]))
                if not times:
                    break
                fixed.append(([(length, 2)] if mate == length else [(length, 1), (mate, 1)], times))
                count[length] -= times
                count[mate] -= times
                changed = True
    return fixed


def _single_dominates(count, length, present, mate, room) -> bool:
    own = {length: 1}
    left = [int(x) for x in present[:3] for _ in range(min(3, int(count[x]) - own.get(int(x), 0)))][:3]
    if len(left) < 2 or left[0] + left[1] > room:
        return True
    if len(left) > 2 and sum(left) <= room:
        return False
    # The largest sum of two that fits: for every shorter one the longest partner, from both ends.
    best, low, high = 0, 0, len(present) - 1
    while low <= high:
        a, b = int(present[low]), int(present[high])
        if a + b > room:
            high -= 1
        else:
            if low != high or count[a] - own.get(a, 0) > 1:
                best = max(best, a + b)
            low += 1
    return best <= mate


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of a histogram; equal bins with equal contents are one entry."""
    open_rooms: list[int] = []
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                insort(open_rooms, room)
            bins[room].append((pattern, times))

    for length in range(capacity, 0, -1):
        left = int(count[length])
        # Tightest rooms first; a bin takes all the copies it has room for before the next one.
        for room in open_rooms[bisect_left(open_rooms, length) :]:
            if not left:
                break
            each = room // length
            open_rooms.remove(room)
            for pattern, times in bins.pop(room):
                full = min(times, left // each)
                put(room - each * length, [*pattern, (length, each)], full)
                left -= full * each
                times -= full
                if times and left:
                    put(room - left * length, [*pattern, (length, left)], 1)
                    left, times = 0, times - 1
                put(room, pattern, times)
        if left:
            each = capacity // length
            put(capacity - each * length, [(length, each)], left // each)
            if rest := left % each:
                put(capacity - rest * length, [(length, rest)], 1)
    return [entry for room in open_rooms for entry in bins[room]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(lengths with copies, number of sequences) of every pattern of the packing."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    return reduce_by_dominance(count, capacity) + best_fit(count, capacity)


def _slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (key, times, sequence, offset, length) sorted by key = length * 2**50 + first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            rows.append((length * 2**50 + first, times, sequence, offset, length))
            used[length] = first + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1..capacity).

    ``pieces`` is read several times and must give the same rows each time, as a written table does.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("a length is outside 1..capacity")
    slots = _slots(plan(histogram, capacity))
    spark = pieces.sparkSession
    parts = spark.createDataFrame([(int(k), 1 + n // ROWS_PER_BUCKET) for k, n in histogram.items()], "length long, _parts long")
    # A written row number spreads rows that share or lack a doc_id.
    key = ["_row"] if "_row" in pieces.columns else ["doc_id", "piece"]
    # At most ``capacity`` rows.
    rows = pieces.join(F.broadcast(parts), "length").withColumn("_b", F.pmod(F.xxhash64(*key), "_parts"))
    sums = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", *key)
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1).join(sums, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_b", "_parts", "_before", "_in")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            key = length * 2**50 + rank
            slot = slots[np.searchsorted(slots[:, 0], key, side="right") - 1]
            within = key - slot[:, 0]
            names = [x for x in batch.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(slot[:, 2] + within % slot[:, 1]), pa.array(slot[:, 3] + within // slot[:, 1] * length)],
                [*names, "sequence_id", "offset"],
            )

    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """doc_id, text -> the pieces of all documents and their places in sequences."""
    pieces = token_pieces(docs, path or tokenizer_path(WORD_TOKENIZER), capacity, end)
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    packed = pack(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
