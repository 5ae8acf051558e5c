"""Nearest neighbours across two catalogues in a periodic box."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import V, X, box_dist2, wrap
from boxstats.operators.joins import BROADCAST_ROWS, HOT_KEYS, lookup_join
from boxstats.operators.tree import (
    MAX_SIDE,
    SPLIT_BITS,
    Positions,
    Tree,
    build_tree,
    cell_id,
    children,
    distinct_positions,
    join_points,
    neighbour_pairs,
    pack,
    pair_ids,
    split_pairs,
    union_all,
    unpack,
)
from boxstats.storage import materialize

LEAF_CAP = 64
QUERY_CAP = 512
# Mean points per cell of the first grid, and the most points a query compares directly.
GRID_OCCUPANCY = 4
MAX_TESTS = 16384


def knn(
    queries: DataFrame, data: DataFrame, box: Box, k: int = 1, payload: list[str] = (), qid: str = "pid"
) -> DataFrame:
    """The ``k`` nearest rows of ``data`` (pid, x0..x2) for each query: qid, rank, pid, d2, payload.

    Ties go to the smaller pid. Queries look at the 27 grid cells around them, and in voids
    at wider cells; those with crowded cells nearby descend a tree with bounds instead.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    payload = list(payload)
    near = _nearest(queries, data, box, k, payload, qid)
    asked = queries.select(
        F.col(qid).alias("qid"), *[wrap(F.col(c).cast("double"), box.boxsize).alias(c) for c in X]
    )
    found = lookup_join(asked, near.df, list(X)) if near.has_copies else near.df.withColumnRenamed("pid", "qid")
    return found.select("qid", *X, F.posexplode("near").alias("rank", "t")).select(
        "qid", *X, (F.col("rank") + 1).alias("rank"), "t.*"
    )


def nearest_velocity(data: DataFrame, queries: DataFrame, box: Box) -> DataFrame:
    """Give each query point (pid, x0..x2) the velocity of the nearest data particle."""
    found = knn(queries, data, box, 1, list(V))
    return found.select(F.col("qid").alias("pid"), *X, *V)


def _candidates(data: DataFrame, box: Box, k: int, payload: list[str]) -> Positions:
    """Data rows that can be among the k nearest of anything: at most k copies a position."""
    if k == 1:
        return distinct_positions(data, box, with_first=payload)
    rows = data.select("pid", *payload, *[wrap(F.col(c).cast("double"), box.boxsize).alias(c) for c in X])
    # The limit on the rank runs before the shuffle as well as after it.
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*X).orderBy("pid")))
    kept = materialize(ranked.filter(F.col("_r") <= k).drop("_r"))
    n = kept.count()
    return Positions(kept, n, n)


def _nearest(queries, data, box, k, payload, qid) -> Positions:
    points = _candidates(data, box, k, payload)
    if points.rows == 0:
        raise ValueError("the catalogue is empty")
    asked = distinct_positions(queries.select(F.col(qid).alias("pid"), *X), box)
    level = 0
    while points.rows / 8.0 ** (level + 1) >= GRID_OCCUPANCY * k and (2 << level) <= MAX_SIDE:
        level += 1
    done, crowded, left = [], [], asked
    while True:
        best = materialize(_near_cells(left, points, box, level, k, payload))
        if (1 << level) > 2:
            # Whatever lies outside the 27 cells is at least a cell width away.
            width2 = F.lit((box.boxsize / (1 << level)) ** 2)
            last = F.element_at("near", -1)
            sure = (F.size("near") >= min(k, points.rows)) & (last["d2"] < width2)
            sure = F.coalesce(sure, F.lit(False))
        else:
            sure = F.lit(True)
        done.append(best.filter(~F.col("crowded") & sure).select("pid", *X, "near"))
        rest = best.select("pid", *X, "crowded", sure.alias("_sure"), F.lit(1).cast("bigint").alias("w"))
        crowded.append(rest.filter("crowded").drop("crowded", "_sure"))
        wider = rest.filter("not crowded and not _sure").drop("crowded", "_sure")
        n_wider = wider.count()
        if n_wider == 0:
            break
        left, level = Positions(materialize(wider), n_wider, n_wider), level - 1
    hard = union_all(crowded)
    n_hard = hard.count()
    if n_hard:
        tree = build_tree(points, box, 1, max(LEAF_CAP, 4 * k))
        done.append(_descend(Positions(materialize(hard), n_hard, n_hard), tree, box, k, payload))
    return Positions(union_all(done), asked.rows, asked.n)


def _closest(
    ids: DataFrame, queries: DataFrame, points: DataFrame, box: Box, k: int, payload: list[str]
) -> DataFrame:
    """The k smallest (d2, pid) of each query over the id pairs, as an array ``near``."""
    asked = queries.select("cid", "pid", *X)
    given = points.select("cid", "pid", *X, *payload)
    entry = F.struct("d2", F.col("b_pid").alias("pid"), *[F.col(f"b_{p}").alias(p) for p in payload])
    where = [F.first(f"a_{c}").alias(c) for c in X]
    if k == 1:
        # A minimum of plain numbers is a hash aggregate; a minimum of rows would sort every
        # candidate. So find the distance first, and the row only among those at it.
        # The second look goes to the leaf pairs that hold a minimum.
        least = join_points(ids, asked, given.select("cid", "pid", *X), box)
        per_leaf = materialize(least.groupBy("a_cid", "a_pid", "b_cid").agg(F.min("d2").alias("best")))
        best = per_leaf.groupBy("a_cid", "a_pid").agg(F.min("best").alias("best"))
        asked = materialize(asked.join(best.withColumnsRenamed({"a_cid": "cid", "a_pid": "pid"}), ["cid", "pid"]))
        winners = per_leaf.join(best, ["a_cid", "a_pid", "best"]).select("a_cid", "b_cid").distinct()
        rows = join_points(ids.join(winners, ["a_cid", "b_cid"]), asked, given, box).filter("d2 = a_best")
        near = rows.groupBy("a_cid", "a_pid").agg(*where, F.array(F.min(entry)).alias("near"))
    else:
        order = Window.partitionBy("a_cid", "a_pid").orderBy("d2", "b_pid")
        rows = join_points(ids, asked, given, box).withColumn("_r", F.row_number().over(order))
        top = rows.filter(F.col("_r") <= k)
        near = top.groupBy("a_cid", "a_pid").agg(*where, F.sort_array(F.collect_list(entry)).alias("near"))
    return near.withColumnRenamed("a_pid", "pid")


def _near_cells(asked: Positions, points: Positions, box: Box, level: int, k: int, payload: list[str]) -> DataFrame:
    """Every query position with the nearest points of the 27 grid cells around it.

    Queries are grouped by leaf cells of at most QUERY_CAP. Those with more than MAX_TESTS
    points around them come back as ``crowded`` instead.
    """
    side = 1 << level
    own = build_tree(asked, box, side, QUERY_CAP, start=0)
    leaves = own.leaves().select(F.col("cid").alias("a_cid"), "home", F.col("home_lvl").alias("lvl"), "n")
    _, *c = unpack(F.col("home"))
    leaves = leaves.withColumns({f"c{i}": c[i] for i in range(3)}).select(
        "a_cid", "n", *[F.expr(f"shiftright(c{i}, {SPLIT_BITS} * lvl)").alias(f"c{i}") for i in range(3)]
    )
    steps = F.array(*[F.lit(s) for s in sorted({o % side for o in (-1, 0, 1)})])
    for i in range(3):
        leaves = leaves.withColumn(f"s{i}", F.explode(steps))
    near_id = pack(F.lit(0), [F.pmod(F.col(f"c{i}") + F.col(f"s{i}"), F.lit(side)) for i in range(3)])
    gridded = points.df.withColumn("cid", cell_id(box, side, 0))
    counts = gridded.groupBy(F.col("cid").alias("b_cid")).agg(F.count(F.lit(1)).alias("m"))
    ids = leaves.select("a_cid", "n", near_id.alias("b_cid")).join(counts, "b_cid")
    # At most 27 rows share a leaf.
    around = F.sum("m").over(Window.partitionBy("a_cid"))
    ids = materialize(ids.withColumn("around", around).withColumn("tests", F.col("n").cast("double") * F.col("m")))
    flags = ids.filter(F.col("around") > MAX_TESTS).select(F.col("a_cid").alias("cid"), F.lit(True).alias("crowded"))
    direct = ids.filter(F.col("around") <= MAX_TESTS).select("a_cid", "b_cid", "tests")
    # Only points in cells that some query looks at take part; the fullest cells are never among them.
    named = direct.select(F.col("b_cid").alias("cid")).distinct()
    n_named = named.count()
    if n_named <= BROADCAST_ROWS:
        gridded = gridded.join(F.broadcast(named), "cid", "left_semi")
    else:
        full = counts.filter(F.col("m") > MAX_TESTS).orderBy(F.desc("m"), "b_cid").limit(HOT_KEYS)
        gridded = gridded.join(F.broadcast(full.select(F.col("b_cid").alias("cid"))), "cid", "left_anti")
        gridded = gridded.join(named, "cid", "left_semi")
    near = _closest(direct, own.points, gridded, box, k, payload)
    near = near.select(F.col("a_cid").alias("cid"), "pid", "near")
    out = own.points.select("cid", "pid", *X).join(near, ["cid", "pid"], "left")
    return out.join(flags.distinct(), "cid", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def _descend(asked: Positions, tree: Tree, box: Box, k: int, payload: list[str]) -> DataFrame:
    """Exact search for any distribution: pair query cells with data cells from the root down.

    The far distance of the data cells that together hold k points bounds the answer of
    every query in a cell; data cells beyond that bound are dropped before the next split.
    Query leaves hold one position, so the bound is as tight there as the data are dense.
    """
    own = build_tree(asked, box, 1, 1)
    near2, far2 = box_dist2("a", "b", box.boxsize)
    infinity = F.lit(float("inf"))
    level = neighbour_pairs(own, tree, half=False).withColumn("bound", infinity)
    by_far = Window.partitionBy("a.cid").orderBy("far2", "b.cid")
    per_cell = Window.partitionBy("a.cid")
    ka, kb = children(own, "a"), children(tree, "b")
    depth = max(own.depth, tree.depth)
    for step in range(depth + 1):
        level = level.withColumn("near2", near2).filter("near2 <= bound").withColumn("far2", far2)
        level = level.withColumn("held", F.sum("b.n").over(by_far))
        enough = F.min(F.when(F.col("held") >= k, F.col("far2"))).over(per_cell)
        level = level.withColumn("bound", F.least("bound", F.coalesce(enough, infinity)))
        level = materialize(level.filter("near2 <= bound").select("a", "b", "bound"))
        if step < depth:
            level = split_pairs(level, ka, kb, half=False)
    near = _closest(pair_ids(level).drop("a_block", "b_block"), own.points, tree.points, box, k, payload)
    return near.select("pid", *X, "near")
