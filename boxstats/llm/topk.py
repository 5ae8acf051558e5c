"""Exact top-k search by tiles: the tiles lie in a grid of groups of queries and groups of data. A task holds one
cell of the grid, goes through the products of its tiles and keeps the best few of every query; a tree of merges
brings the short lists of a query together. Tiles meet in a shuffle, never by broadcast, and travel once per group
of the other side.

Vectors become integers, floor(scale * x), and scores are integer inner products, exact as long as
they fit a long. Rows whose vector is null, empty, or holds a null or non-finite component take no
part, nor do rows without id. Vectors of different length do not meet. Rows of equal id are
separate candidates, except that a query never meets its own id. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.storage import materialize

#: Rows of a data tile and of a query tile; a product is at most the two multiplied.
TILE, QUERY_TILE = 4096, 512
#: Short lists that meet in one step of the merge tree.
FAN_IN = 64
#: Mean bytes of the vectors of a data group and of a query group; a task holds one of each.
DATA_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Cells of the grid per core, as far as there are tiles.
CELLS_PER_CORE = 4


def _integers(column: pa.Array, scale: float):
    """Row numbers and int64 vectors by length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(length)])
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        block = values[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(block).all(axis=1)
        scaled = np.floor(scale * block[good])
        if scaled.size and np.abs(scaled).max() >= 2.0**62:
            raise ValueError("a scaled component does not fit a long")
        yield rows[good], scaled.astype(np.int64)


def tiles(rows: DataFrame, ident: str, vector: str, scale: float, size: int) -> DataFrame:
    """(dim, width, ids, body): runs of up to ``size`` rows of a partition, sorted by id, as integers of the fewest
    bytes (``width``) that hold them; no shuffle."""

    def pack(batches):
        held: dict[int, list] = {}

        def put(dim, force):
            ids, body = (np.concatenate(x) for x in zip(*held[dim]))
            while len(ids) and (force or len(ids) >= size):
                part = np.argsort(ids[:size], kind="stable")
                yield dim, ids[:size][part], body[:size][part]
                ids, body = ids[size:], body[size:]
            held[dim] = [(ids, body)] if len(ids) else []

        def batch_of(dim, ids, body):
            width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= body.min() and body.max() < 1 << 8 * w - 1)
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()), "width": pa.array([width], pa.int32()),
                    "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "body": pa.array([body.astype(f"<i{width}").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for at, block in _integers(batch.column("vector"), scale):
                dim = block.shape[1]
                held.setdefault(dim, []).append((ids[at], block))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    for tile in put(dim, False):
                        yield batch_of(*tile)
        for dim in list(held):
            if held[dim]:
                for tile in put(dim, True):
                    yield batch_of(*tile)

    named = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return named.filter("id IS NOT NULL AND vector IS NOT NULL").mapInArrow(pack, "dim int, width int, ids binary, body binary")


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Rows, ids and scores of the k best of every row of ``scores``; ids ascend along columns."""
    n = scores.shape[1]
    real = ids[None, :] != own[:, None]
    # Score and reversed place in one key make the choice among ties exact.
    low, high = int(scores.min()), int(scores.max())
    if max(abs(low), abs(high)) < (1 << 62) // n:
        key = scores * n + np.arange(n - 1, -1, -1)
        key[~real] = -np.iinfo(np.int64).max
        top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    else:
        order = np.argsort(-scores, axis=1, kind="stable")
        moved = np.take_along_axis(real, order, 1)
        top = np.take_along_axis(order, np.argsort(~moved, axis=1, kind="stable"), 1)[:, :k]
    rows = np.repeat(np.arange(len(scores)), top.shape[1])
    top = top.ravel()
    good = real[rows, top]
    rows, top = rows[good], top[good]
    return rows, ids[top], scores[rows, top]


class _Tile:
    """Ids and vectors of a tile, with what bounds its scores."""

    def __init__(self, dim: int, width: int, ids: bytes, body: bytes):
        self.ids, self.x = np.frombuffer(ids, "<i8"), np.frombuffer(body, f"<i{width}").reshape(-1, dim)
        self.dim, self.most = dim, max(float(self.x.max()), -float(self.x.min()))
        self.floats = self.x.astype(float)
        # Rounded up, as a bound must be.
        self.norm = float(np.sqrt((self.floats * self.floats).sum(1).max())) * (1 + 1e-9)
        if self.norm < 1 << 24:
            self.floats = self.floats.astype(np.float32)


def _scores(q: _Tile, d: _Tile) -> np.ndarray:
    """Inner products, exact; floats where every partial sum is a whole number that they hold."""
    if q.most * d.most * q.dim >= 2.0**63:
        raise ValueError("a score may not fit a long")
    # A sum over some of the components is at most the product of the norms.
    reach = q.norm * d.norm
    if reach >= 2.0**53:
        return q.x.astype(np.int64) @ d.x.astype(np.int64).T
    kind = np.float32 if reach < 1 << 24 else float
    return q.floats.astype(kind, copy=False) @ d.floats.astype(kind, copy=False).T


class _Lists:
    """The k best of every query of a tile so far, ordered by row, falling score and id."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.rows = self.ids = self.scores = np.zeros(0, np.int64)
        # The score that a candidate must reach: the k-th, once there are k.
        self.least = np.full(len(own), np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least
        if scores.dtype != np.int64:
            # Scores beyond the type can't be reached or are reached by all, as they are when rounded.
            least = least.astype(scores.dtype)
        near = scores >= least[:, None]
        if np.count_nonzero(near) > 4 * self.k * len(self.own):
            rows, found, best = _best(scores.astype(np.int64, copy=False), ids, self.own, self.k)
        else:
            rows, at = np.nonzero(near)
            found, best = ids[at], scores[rows, at].astype(np.int64)
            real = found != self.own[rows]
            rows, found, best = rows[real], found[real], best[real]
        if not len(rows):
            return
        rows, found, best = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, found), (self.scores, best)))
        order = np.lexsort((found, -best, rows))
        rows = rows[order]
        begin = np.searchsorted(rows, np.arange(len(self.own)))
        place = np.arange(len(rows)) - begin[rows]
        kept = place < self.k
        self.rows, self.ids, self.scores = rows[kept], found[order][kept], best[order][kept]
        last = place[kept] == self.k - 1
        self.least[self.rows[last]] = self.scores[last]


def _cell(k: int):
    """The function of one cell of the grid, for a cogrouped ``applyInArrow``: the k best of every query in it."""

    def run(key, asked: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query_id", "q_tile", "query_row", "tile", "id", "score"]
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if asked.num_rows and data.num_rows:
            dim, tile = key[0].as_py(), key[2].as_py()
            columns = [asked.column(c).to_pylist() for c in ("q_width", "q_ids", "q_body")]
            queries = [_Tile(dim, *row) for row in zip(*columns)]
            lists = [_Lists(q.ids, k) for q in queries]
            columns = [data.column(c) for c in ("width", "ids", "body")]
            for row in range(data.num_rows):
                d = _Tile(dim, *[c[row].as_py() for c in columns])
                for q, best in zip(queries, lists):
                    best.add(_scores(q, d), d.ids)
            for q_tile, best in zip(asked.column("q_tile").to_pylist(), lists):
                n = len(best.rows)
                for part, values in zip(parts, (best.own[best.rows], np.full(n, q_tile), best.rows, np.full(n, tile), best.ids, best.scores)):
                    part.append(values)
        return pa.table({c: np.concatenate(part) for c, part in zip(names, parts)})

    return run


def _grid(data: DataFrame, asked: DataFrame) -> tuple[int, int]:
    """Groups of data and of queries. Memory bounds both; data is cut further until every core has cells."""
    size = F.coalesce(F.sum(F.octet_length("body")), F.lit(0))
    (tiles_in, data_bytes), (_, query_bytes) = (df.agg(F.count(F.lit(1)), size).first() for df in (data, asked))
    query_groups = max(1, -(-query_bytes // QUERY_BYTES))
    cells = CELLS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-data_bytes // DATA_BYTES), min(tiles_in, -(-cells // query_groups))), query_groups


def top_k(queries: DataFrame, candidates: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), ``ident``, score: the k best candidates of each query row, exactly. Rows that
    repeat an id are queries, and candidates, of their own; a query's own id is never its candidate."""
    data = materialize(tiles(candidates, ident, vector, scale, TILE).withColumn("shard", F.monotonically_increasing_id()))
    asked = materialize(tiles(queries, ident, vector, scale, QUERY_TILE).withColumn("q_tile", F.monotonically_increasing_id()))
    shards, query_groups = _grid(data, asked)

    def dealt(column: str, groups: int):
        return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int")

    def every(groups: int):
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    # A join with every group of the other side could be planned as a broadcast of all the copies; a cogroup can't.
    key = ["dim", "query_group", "shard"]
    data = data.select("dim", every(query_groups).alias("query_group"), dealt("shard", shards).alias("shard"), "width", "ids", "body")
    asked = asked.select(
        "dim", dealt("q_tile", query_groups).alias("query_group"), every(shards).alias("shard"), "q_tile",
        F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body"),
    )
    sides = [df.repartition(shards * query_groups, *key).groupBy(*key) for df in (asked, data)]
    lists = sides[0].cogroup(sides[1]).applyInArrow(_cell(k), "query_id long, q_tile long, query_row long, tile long, id long, score long")
    # Tree merge: the lists of FAN_IN shards at a time, so no group holds more than FAN_IN * k rows
    # of a query. A query is a row: rows of one id have lists of their own.
    query = ["q_tile", "query_row"]
    level = shards
    while level > FAN_IN:
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("long"))
        lists = _first(lists, [*query, "tile"], k)
        level = -(-level // FAN_IN)
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "id"))
    ranked = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(ident), "score")


def _first(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return lists.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
