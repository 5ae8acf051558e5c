"""N-gram Jaccard join: MinHash banding finds candidates, full sets of word n-grams decide.

1. Every text becomes its set of hashed five-word shingles (a text of one to four words is one
   shingle), a set key, and one hash per band of its MinHash signature. Equal sets form a class
   whose smallest doc_id stands for it, so copies are never paired.
2. Classes meet on band hashes. Buckets give star edges, whose components bound where links can
   be; a large component is cut into blocks of bounded size by set size and hash.
3. Block pairs that share a bucket are verified on full sets, all pairs at once, and return counts
   and spanning edges only. So a group of m different near copies costs m^2 comparisons inside
   tasks, as an exact number of links must, but rows in proportion to m * (m / BLOCK_ROWS).

Null and empty texts, and texts of spaces, have no shingles: each is a class of its own with no
links. Rows without doc_id are left alone: class null, no links. Rows that repeat a doc_id count as
copies if their texts are equal; texts that share a doc_id are taken as one document in the groups.
Long texts are shingled whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import Rolling, give_back, mix64, runs, space_mask, utf8, window_hashes, word_bounds
from boxstats.operators.components import connected_components
from boxstats.storage import materialize

WIDTH, SIMILARITY = 5, 0.8
#: A pair at the similarity meets in a band with this probability at least.
RECALL = 0.9995
#: Hash values of a signature at most.
SIGNATURE = 120
#: Limits of a block: classes and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
#: Rows with their sets that a partition of the verification takes on average.
SHIPPED_ROWS = 2000
#: Candidate ids up to this number reach the texts by broadcast (8 bytes each), more by a shuffle.
BROADCAST_IDS = 250_000


def banding(similarity: float = SIMILARITY, recall: float = RECALL, size: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands still reach the recall within ``size`` values."""
    for rows in range(size, 0, -1):
        hit = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= size:
            return bands, rows
    raise ValueError("no banding of this size reaches the recall")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted by (row, hash), and where rows begin."""
    n = len(offsets) - 1
    starts, ends, rows = word_bounds(data, offsets, space_mask(data))
    words = Rolling(data).spans(starts, ends)
    hashes, at = window_hashes(words, rows, width)
    owner = rows[at]
    count = np.bincount(rows, minlength=n)
    for short in range(1, width):
        few = count[rows] == short
        if few.any():
            h, a = window_hashes(words[few], rows[few], short)
            hashes, owner = np.concatenate([hashes, h]), np.concatenate([owner, rows[few][a]])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16) if n < 65536 else owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def _bands(hashes: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """uint64 [bands, texts]; columns of texts without shingles mean nothing."""
    filled = np.flatnonzero(np.diff(begin))
    out = np.zeros((bands, len(begin) - 1), np.uint64)
    if not len(filled):
        return out
    at = begin[filled]
    random = np.random.default_rng(20240229)
    for band in range(bands):
        total = np.full(len(filled), band + 1, np.uint64)
        for _ in range(rows):
            a, b = random.integers(0, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((hashes * (a | np.uint64(1)) + b) >> np.uint64(20), at)
            total = mix64(total * np.uint64(0x2545F4914F6CDD1D) + least)
        out[band, filled] = total
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text -> doc_id, k1, k2 (key of the shingle set), n, bands."""

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                hashes, begin = shingles(*utf8(batch.column("text")), width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x5BD1E995, 0x1B873593)]
                keys = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
                flat = _bands(hashes, begin, bands, rows).T.reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.diff(begin).astype(np.int32)), lists],
                    ["doc_id", "k1", "k2", "n", "bands"],
                )

    return docs.mapInArrow(work, "doc_id long, k1 long, k2 long, n int, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text -> rep, set: the sorted distinct shingle hashes as bytes."""

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                hashes, begin = shingles(*utf8(batch.column("text")), width)
                body = hashes.astype("<u8").tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"rep": batch.column("doc_id"), "set": pa.array([body[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:])], pa.binary())}
                )

    return docs.mapInArrow(work, "rep long, set binary")


def _roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of 0..n-1."""
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        parent = np.minimum(parent, parent[parent])
        if (parent == before).all():
            return parent


def _similar(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets; between the sides if both occur, else all."""
    size = np.array([len(s) for s in sets])
    m = len(sets)
    ids, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)
    dense, start = max(1, (1 << 22) // m), 0
    _, column = np.unique(column, return_inverse=True)
    width = int(column[-1]) + 1 if len(column) else 0
    while start < width:
        stop = min(start + dense, width)
        a, b = np.searchsorted(column, [start, stop])
        block = np.zeros((m, stop - start), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        common += block @ block.T
        start = stop
    # Whole numbers below 2**24 are exact here; |A & B| / |A | B| >= s, without a division.
    union = size[:, None] + size[None, :] - common
    near = np.triu(common >= similarity * union - 1e-9, 1)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    return np.nonzero(near)


def verify(blocks: DataFrame, similarity: float) -> DataFrame:
    """(task, side, rep, weight, set), a task's rows together -> (rep, root, links)."""

    def work(batches):
        held, current = [], None

        def settle():
            rep, weight, side = (np.array(x) for x in list(zip(*held))[:3])
            i, j = _similar([np.frombuffer(h[3], "<u8") for h in held], side.astype(bool), similarity)
            if not len(i):
                return None
            links = np.bincount(i, weights=weight[j], minlength=len(rep)) + np.bincount(j, weights=weight[i], minlength=len(rep))
            order = np.argsort(np.argsort(rep))
            root = np.empty(len(rep), np.int64)
            root[:] = np.sort(rep)[_roots(np.arange(len(rep)), order[i], order[j])][order]
            hit = links > 0
            return pa.RecordBatch.from_pydict({"rep": rep[hit], "root": root[hit], "links": links[hit].astype(np.int64)})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "rep", "weight", "side", "set")]
            for task, *row in zip(*columns):
                if task != current and held:
                    if (out := settle()) is not None:
                        yield out
                    held = []
                current = task
                held.append(row)
        if held and (out := settle()) is not None:
            yield out
        give_back()

    return blocks.select("task", "rep", "weight", "side", "set").mapInArrow(work, "rep long, root long, links long")


def join(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id and text -> doc_id, class_id (smallest doc_id of the group), n_links.

    ``n_links`` counts the other documents, copies included, whose similarity to this one reaches
    ``similarity``. Groups are the components of these links.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bands, rows = banding(similarity, recall)
    units = materialize(signatures(docs, width, bands, rows))
    known = units.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # All members of a class have equal bands; the representative's own row brings them.
    reps = known.join(classes.select("k1", "k2", "n", F.col("rep").alias("doc_id")), ["k1", "k2", "n", "doc_id"]).dropDuplicates(["k1", "k2", "n"])
    buckets = reps.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("bucket"))
    many = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"), F.min("rep").alias("first")).filter("_m > 1").drop("_m")
    members = materialize(buckets.join(many, "bucket"))
    tree = connected_components(members.filter("rep != first").select(F.col("rep").alias("src"), F.col("first").alias("dst")).distinct())
    inside = materialize(
        members.select("rep", "n").distinct().join(tree.select(F.col("id").alias("rep"), "comp"), "rep")
        .join(classes.select("rep", "n", F.col("copies").alias("weight")), ["rep", "n"])
    )
    placed = materialize(_blocks(inside, similarity))
    tasks = materialize(_tasks(members, placed))
    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    if placed.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # Texts of one doc_id are one document here; the least of their sets stands for it.
    sets = _sets(docs.join(ids, "doc_id"), width).groupBy("rep").agg(F.min("set").alias("set"))
    sides = tasks.select("comp", F.col("i").alias("block"), "task", F.lit(0).alias("side")).unionByName(
        tasks.filter("i != j").select("comp", F.col("j").alias("block"), "task", F.lit(1).alias("side"))
    )
    shipped = placed.join(sides, ["comp", "block"]).select("task", "side", "rep", "weight").join(sets, "rep")
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, _shipped_rows(placed, sides) // SHIPPED_ROWS)
    found = materialize(verify(shipped.repartition(int(n_tasks), "task").sortWithinPartitions("task", "side"), similarity))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct())
    of_rep = links.join(groups.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("rep", "links", "comp")
    of_class = classes.join(of_rep, "rep", "left").select(
        "k1", "k2", "n", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = units.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.select("doc_id", "k1", "k2", "n").join(of_class, ["k1", "k2", "n"]).select("doc_id", "class_id", "n_links").unionByName(alone)


def _shipped_rows(placed: DataFrame, sides: DataFrame) -> int:
    """Rows of all block tasks: a class goes to every task of its block."""
    rows = placed.groupBy("comp", "block").agg(F.count(F.lit(1)).alias("_rows"))
    return sides.join(rows, ["comp", "block"]).agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]


def _blocks(inside: DataFrame, similarity: float) -> DataFrame:
    """Adds the block of each class in its component. Sets in blocks whose size classes lie two or
    more apart differ by more than the factor ``1 / similarity``, so they cannot be similar."""
    totals = inside.groupBy("comp").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    fits = (F.col("_all") <= BLOCK_SHINGLES) & (F.col("_rows") <= BLOCK_ROWS)
    big = totals.filter(~fits).select("comp")
    size = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)).cast("int")
    small = inside.join(big, "comp", "left_anti").select("comp", "rep", "n", "weight", F.lit(-1).alias("size"), F.lit(0).alias("part"))
    large = inside.join(big, "comp").withColumn("size", size)
    per = large.groupBy("comp", "size").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / (0.8 * BLOCK_ROWS))).cast("int").alias("_parts")
    )
    large = large.join(per, ["comp", "size"]).select(
        "comp", "rep", "n", "weight", "size", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int").alias("part")
    )
    return small.unionByName(large).withColumn("block", F.col("size").cast("long") * 2**31 + F.col("part"))


def _tasks(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(comp, i, j, task): blocks with themselves, and pairs of blocks of a component that meet in a
    bucket and whose sizes allow a link."""
    own = placed.select("comp", "block").distinct().select("comp", F.col("block").alias("i"), F.col("block").alias("j"))
    large = placed.filter("size >= 0").select("comp", "rep", "block", "size")
    meet = members.join(large, "rep").select("bucket", "comp", "block", "size").distinct()
    a, b = (meet.select("bucket", "comp", F.col("block").alias(x), F.col("size").alias(f"_{x}")) for x in ("i", "j"))
    pairs = a.join(b, ["bucket", "comp"]).filter("i < j AND abs(_i - _j) <= 1").select("comp", "i", "j").distinct()
    return own.unionByName(pairs).withColumn("task", F.xxhash64("comp", "i", "j"))
