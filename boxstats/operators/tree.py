"""Adaptive cells for spatial joins in a periodic box.

A uniform grid of base cells is split, only where it is crowded, until a leaf holds at most
``cap`` distinct positions. Cells that are too small to be split once more are dealt by a hash
of pid into leaves that may overlap. Copies of a position are one row with a weight, so neither
a crowded cell nor a pile of copies can end up as one unbounded group. Joins first pair the
cells (few rows, tight bounds, equi-joins on the cell id) and then only the points of those
leaf pairs that the bounds cannot settle. Neighbouring leaves form blocks, and a leaf is shipped
once to every block that it meets, not once to every leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES, X, box_dist2, dist2, not_finite, wrap
from boxstats.operators.joins import BROADCAST_ROWS, lookup_join
from boxstats.operators.leafpairs import Fold, folder
from boxstats.sizing import tasks_for
from boxstats.storage import materialize, materialize_observed

# A cell id packs the level and three indices of AXIS_BITS bits each.
AXIS_BITS = 19
# A split cuts every axis into 2^SPLIT_BITS parts.
SPLIT_BITS = 2
MAX_SIDE = 1 << AXIS_BITS
MEAN_OCCUPANCY = 16
# Point tests of one join key, where leaves have no blocks.
KEY_TESTS = 50_000_000
# Points of a block of leaves, but for one leaf more. The square bounds the tests of a pair of blocks.
BLOCK_POINTS = 4096
# The same where leaves are folded: a task holds the points of two blocks.
FOLD_POINTS = 131_072
# Points that a pass of a fold ships: PASS_POINTS, or PASS_SHARE times all points if these are more. The shuffle files
# of a pass are deleted before the next, so their size follows the points, whatever the number of their pairs.
PASS_POINTS, PASS_SHARE = 4_000_000, 1.0


def pack(level: Column, c: list[Column]) -> Column:
    side = F.lit(MAX_SIDE).cast("bigint")
    return ((level.cast("bigint") * side + c[0]) * side + c[1]) * side + c[2]


def unpack(cid: Column) -> list[Column]:
    """Level and indices of a cell id."""
    low = F.lit(MAX_SIDE - 1).cast("bigint")
    part = [F.shiftright(cid, (2 - i) * AXIS_BITS).bitwiseAND(low) for i in AXES]
    return [F.shiftright(cid, 3 * AXIS_BITS), *part]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def never_null(columns: list[str], prefix: str = "") -> list[str]:
    """SQL for renamed columns that Spark knows to hold no NULL, which keeps the checks out of
    the generated pair loop (it must stay small enough to be compiled to machine code)."""
    none = {"leaf": "false", "pids": "array()", "us": "array()"}
    return [f"coalesce({c}, {none.get(c, 0)}) AS {prefix}{c}" for c in columns]


@dataclass(frozen=True)
class Positions:
    """Distinct positions of a catalogue: x0..x2, smallest pid, copies w and summed columns."""

    df: DataFrame
    rows: int
    n: int

    @property
    def has_copies(self) -> bool:
        return self.rows != self.n


def distinct_positions(
    points: DataFrame, box: Box, sums: dict[str, Column] | None = None, with_first: list[str] = (), with_last: bool = False
) -> Positions:
    """Merge the copies of a position; ``with_first`` keeps those columns of the smallest pid, ``with_last`` adds the
    largest one as ``last``."""
    values = [F.col(c) for c in (*X, *with_first)] + list((sums or {}).values())
    bad = reduce(lambda p, q: p | q, [not_finite(c) for c in values])
    wrapped = points.withColumn("_bad", bad.cast("int")).withColumns({c: wrap(F.col(c).cast("double"), box.boxsize) for c in X})
    # Plain numbers in the buffers keep this a hash aggregate; pids are unique, so min_by is exact.
    df = wrapped.groupBy(*X).agg(
        F.min("pid").alias("pid"),
        *([F.max("pid").alias("last")] if with_last else []),
        *[F.min_by(c, "pid").alias(c) for c in with_first],
        F.count(F.lit(1)).alias("w"),
        F.sum("_bad").alias("_bad"),
        *[F.sum(c).alias(name) for name, c in (sums or {}).items()],
    )
    df, size = materialize_observed(df, rows=F.count(F.lit(1)), n=F.sum("w"), bad=F.sum("_bad"))
    if size["bad"]:
        raise ValueError(f"{size['bad']} rows hold a NULL, NaN or infinite position or value")
    kept = df.drop("_bad")
    kept._written_to = df._written_to
    return Positions(kept, size["rows"], size["n"] or 0)


@dataclass(frozen=True)
class Tree:
    """Leaf points (column ``cid``) and all cells from level 0 down to the leaves."""

    points: DataFrame
    cells: DataFrame
    box: Box
    side: int
    depth: int
    sums: tuple[str, ...] = field(default=())

    def cell_struct(self, name: str) -> Column:
        bounds = [f"{b}{i}" for b in ("lo", "hi") for i in AXES]
        fields = ["cid", "leaf", "n", "rep", "block", *bounds, *self.sums]
        return F.expr(f"struct({', '.join(never_null(fields))})").alias(name)

    def leaves(self) -> DataFrame:
        """(cid, n, home, home_lvl, lvl): every leaf with the grid cell that it lies in."""
        dealt = F.col("cid") < 0
        return self.cells.filter("leaf").select(
            "cid", "n", F.when(dealt, F.col("parent")).otherwise(F.col("cid")).alias("home"),
            (F.col("lvl") - dealt.cast("int")).alias("home_lvl"), "lvl",
        )

    def ancestors(self) -> DataFrame:
        """(cid, anc, lvl): every leaf with each cell that contains it, itself included."""
        return _with_ancestors(self.leaves().withColumnRenamed("lvl", "_leaf_lvl")).select("cid", "anc", "lvl")


def _with_ancestors(leaves: DataFrame) -> DataFrame:
    _, *c = unpack(F.col("home"))
    indexed = leaves.withColumns({f"_c{i}": c[i] for i in AXES}).withColumn(
        "lvl", F.explode(F.expr("sequence(0, _leaf_lvl)"))
    )
    shifted = [F.expr(f"shiftright(_c{i}, {SPLIT_BITS} * greatest(home_lvl - lvl, 0))") for i in AXES]
    anc = F.when(F.col("lvl") > F.col("home_lvl"), F.col("cid")).otherwise(pack(F.col("lvl"), shifted))
    return indexed.withColumn("anc", anc).drop("_c0", "_c1", "_c2")


def _deal(points: DataFrame, cap: int) -> Column:
    """The id of the dealt leaf of a point in a cell of ``_n`` positions; below zero, which no grid
    cell is. Small caps give every position a leaf, larger ones half of ``cap`` on average."""
    share = F.col("pid") if cap < 64 else F.pmod(F.xxhash64("pid"), F.ceil(2 * F.col("_n") / cap))
    return F.xxhash64("home", share).bitwiseOR(F.lit(-(1 << 63)))


def cell_index(x: Column, box: Box, side: int, level: int) -> Column:
    """Scaling by a power of two is exact, so a cell is exactly the sum of its parts."""
    parts = 1 << (SPLIT_BITS * level)
    t = x * F.lit(float(side)) / F.lit(float(box.boxsize)) * F.lit(float(parts))
    return F.least(F.floor(t), F.lit(side * parts - 1).cast("bigint"))


def cell_id(box: Box, side: int, level: int) -> Column:
    return pack(F.lit(level), [cell_index(F.col(c), box, side, level) for c in X])


def base_side(box: Box, radius: float, rows: int, occupancy: int = MEAN_OCCUPANCY) -> int:
    """Cells per axis: at least ``radius`` wide, and not far emptier than ``occupancy``."""
    fit = int(box.boxsize / radius) if radius > 0 else MAX_SIDE
    while fit > 1 and box.boxsize / fit < radius:
        fit -= 1
    useful = int((rows / occupancy) ** (1.0 / 3.0))
    return max(1, min(fit, useful, MAX_SIDE >> 4))


def start_level(side: int, rows: int, cap: int) -> int:
    """First level at which evenly spread positions would leave no crowded cell."""
    level = 0
    while rows / float(_side_at(side, level)) ** 3 > 0.5 * cap and _side_at(side, level + 1) <= MAX_SIDE:
        level += 1
    return level


def _side_at(side: int, level: int) -> int:
    return side << (SPLIT_BITS * level)


def build_tree(
    positions: Positions, box: Box, side: int, cap: int, sums: dict[str, Column] | None = None, start: int | None = None, fold: bool = False
) -> Tree:
    """Every cell gets its point count n, smallest pid ``rep``, tight bounds and ``sums``:
    totals of column expressions over its points. ``fold`` makes the blocks larger, for ``fold_pairs``; the sum
    ``load``, if there is one, stands for the points there."""
    if start is None:
        start = start_level(side, positions.rows, cap)
    sums = sums or {}
    bounds = []
    for i in AXES:
        bounds += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}")]
    totals = [F.sum(c).alias(s) for s, c in sums.items()]

    def cells_of(df: DataFrame, lvl: int, home_lvl: int) -> DataFrame:
        cells = df.groupBy("cid").agg(
            F.count(F.lit(1)).alias("n"), F.min("pid").alias("rep"), F.min("home").alias("home"), *bounds, *totals
        )
        return materialize(cells.withColumns({"lvl": F.lit(lvl), "home_lvl": F.lit(home_lvl)}))

    level, pending, leaves, leaf_cells, dealt = start, positions.df, [], [], False
    while True:
        pending = pending.withColumn("cid", cell_id(box, side, level)).withColumn("home", F.col("cid"))
        found = cells_of(pending, level, level)
        crowded = found.filter(F.col("n") > cap).select("cid", F.col("n").alias("_n"))
        n_crowded = crowded.count()
        if n_crowded == 0:
            leaves.append(pending.withColumn("lvl", F.lit(level)))
            leaf_cells.append(found)
            break
        pending = lookup_join(pending, crowded, ["cid"], "left", n_crowded)
        if n_crowded > BROADCAST_ROWS:
            pending = materialize(pending)
        leaves.append(pending.filter("_n is null").drop("_n").withColumn("lvl", F.lit(level)))
        leaf_cells.append(found.filter(F.col("n") <= cap))
        # Only the points of crowded cells are written again.
        pending = pending.filter("_n is not null")
        pending = pending if n_crowded > BROADCAST_ROWS else materialize(pending)
        level += 1
        if _side_at(side, level) > MAX_SIDE:
            pending = pending.withColumn("cid", _deal(pending, cap)).drop("_n")
            leaves.append(pending.withColumn("lvl", F.lit(level)))
            leaf_cells.append(cells_of(pending, level, level - 1))
            dealt = True
            break
        pending = pending.drop("_n", "cid")
    points = union_all(leaves).drop("home")
    if len(leaves) > 2:
        points = materialize(points)
    leaf_cells = union_all(leaf_cells)

    def with_blocks(cells: DataFrame) -> DataFrame:
        return _with_fold_blocks(cells, dealt, side, positions.rows) if fold else _with_blocks(cells, dealt)

    if level == 0:
        cells = leaf_cells.drop("home", "home_lvl")
        cells = cells.withColumn("leaf", F.lit(True)).withColumn("parent", F.lit(None).cast("bigint"))
        cells = materialize(with_blocks(cells))
    else:
        merged = []
        for i in AXES:
            merged += [F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
        cells = (
            _with_ancestors(leaf_cells.withColumnRenamed("lvl", "_leaf_lvl"))
            .groupBy(F.col("anc").alias("cid"), "lvl")
            .agg(
                F.sum("n").alias("n"),
                F.min("rep").alias("rep"),
                *merged,
                *[F.sum(s).alias(s) for s in sums],
                F.max(F.col("lvl") == F.col("_leaf_lvl")).alias("leaf"),
                F.min("home").alias("home"),
            )
        )
        _, *c = unpack(F.col("cid"))
        up = pack(F.col("lvl") - 1, [F.shiftright(x, SPLIT_BITS) for x in c])
        up = F.when(F.col("cid") < 0, F.col("home")).otherwise(up)
        cells = cells.withColumn("parent", F.when(F.col("lvl") > 0, up)).drop("home")
        if dealt:
            cells = materialize(cells)
        cells = materialize(with_blocks(cells))
    return Tree(points, cells, box, side, level, tuple(sums))


def _with_blocks(cells: DataFrame, dealt: bool) -> DataFrame:
    """Every leaf with its block: a run of at most 64 siblings (or base cells of one 4 x 4 x 4 cube) of
    BLOCK_POINTS points. Dealt leaves, of which one cell may have any number, are dealt into blocks too."""
    level, *c = unpack(F.col("cid"))
    cube = pack(F.lit(0), [F.shiftright(x, SPLIT_BITS) for x in c])
    group = F.when(F.col("lvl") == 0, F.xxhash64(F.lit("cube"), cube)).otherwise(F.xxhash64(F.lit("parent"), F.col("parent")))
    before = Window.partitionBy("_group").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    run = F.floor(F.coalesce(F.sum(F.when(F.col("leaf"), F.col("n"))).over(before), F.lit(0)) / BLOCK_POINTS)
    block = F.when(F.col("leaf"), F.xxhash64("_group", run)).otherwise(F.lit(0).cast("bigint"))
    return _blocked(cells, dealt, group, block, "n", BLOCK_POINTS)


def _with_fold_blocks(cells: DataFrame, dealt: bool, side: int, rows: int) -> DataFrame:
    """Every leaf with its block, a cube of base cells that holds about FOLD_POINTS points, or a share of the cores if that
    is less. A crowded cube is cut into runs of its leaves."""
    cores = cells.sparkSession.sparkContext.defaultParallelism
    points = min(FOLD_POINTS, max(BLOCK_POINTS, rows // (4 * cores)))
    width = max(1, int((points * side**3 / max(rows, 1)) ** (1.0 / 3.0)))
    index = [f"shiftright(shiftright(cid, {(2 - i) * AXIS_BITS}) & {MAX_SIDE - 1}L, {SPLIT_BITS} * lvl) div {width}" for i in AXES]
    group = F.expr(f"xxhash64('fold', {', '.join(index)})")
    load = "load" if "load" in cells.columns else "n"
    before = Window.partitionBy("_group").orderBy("lvl", "cid").rowsBetween(Window.unboundedPreceding, -1)
    run = F.floor(F.coalesce(F.sum(F.when(F.col("leaf"), F.col(load))).over(before), F.lit(0)) / points)
    block = F.when(F.col("leaf"), F.xxhash64("_group", run)).otherwise(F.lit(0).cast("bigint"))
    return _blocked(cells, dealt, group, block, load, points)


def _blocked(cells: DataFrame, dealt: bool, group: Column, block: Column, load: str, points: int) -> DataFrame:
    grid = cells.filter("cid >= 0") if dealt else cells
    grid = grid.withColumn("_group", group).withColumn("block", block).drop("_group")
    if not dealt:
        return grid
    homes = cells.filter("not leaf").select(F.col("cid").alias("parent"), F.ceil(F.col(load) / points).alias("_blocks"))
    dealt = lookup_join(cells.filter("cid < 0"), homes, ["parent"]).select(*cells.columns, "_blocks")
    return grid.unionByName(dealt.withColumn("block", F.xxhash64("parent", F.pmod(F.xxhash64("cid"), F.col("_blocks")))).drop("_blocks"))


@dataclass(frozen=True)
class CellPairs:
    """``inside``: every point pair is within the radius. ``open``: leaf pairs to test."""

    inside: DataFrame | None
    open: DataFrame


def neighbour_pairs(a: Tree, b: Tree, half: bool) -> DataFrame:
    """Adjacent occupied level-0 cells (a, b); with ``half`` each unordered pair once."""
    steps = sorted({o % a.side for o in (-1, 0, 1)})
    offsets = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(o)]) for o in product(steps, repeat=3)])
    _, *c = unpack(F.col("a.cid"))
    left = a.cells.filter("lvl = 0").select(a.cell_struct("a"), F.explode(offsets).alias("o"))
    target = pack(F.lit(0), [F.pmod(c[i] + F.col(f"o.s{i}"), F.lit(a.side)) for i in AXES])
    left = left.select("a", target.alias("_to"))
    if half:
        left = left.filter(F.col("_to") >= F.col("a.cid"))
    right = b.cells.filter("lvl = 0").select(F.col("cid").alias("_to"), b.cell_struct("b"))
    return left.join(right, "_to").select("a", "b")


def children(tree: Tree, name: str) -> DataFrame:
    """(key, struct): the cells one step below ``key``; a leaf stands for itself."""
    below = tree.cells.filter("parent is not null").select(F.col("parent").alias("_key"), tree.cell_struct(name))
    leaf = tree.cells.filter("leaf").select(F.col("cid").alias("_key"), tree.cell_struct(name))
    return below.unionByName(leaf)


def split_pairs(pairs: DataFrame, ka: DataFrame, kb: DataFrame, half: bool) -> DataFrame:
    """Replace both cells of every pair by their children, as given by ``children``."""
    ka, kb = ka.toDF("_ka", "_na"), kb.toDF("_kb", "_nb")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    out = pairs.join(ka, F.col("a.cid") == F.col("_ka")).join(kb, F.col("b.cid") == F.col("_kb"))
    if half:
        out = out.filter((F.col("a.cid") != F.col("b.cid")) | (F.col("_na.cid") <= F.col("_nb.cid")))
    return out.select(F.col("_na").alias("a"), F.col("_nb").alias("b"), *rest)


def cell_pairs(
    a: Tree, b: Tree, radius2: float, strict: bool, half: bool, settle: Column | None = None, exclude_zero: bool = False
) -> CellPairs:
    """Cell pairs that hold point pairs with d2 < radius2 (``strict``) or d2 <= radius2.

    ``settle`` says when a pair wholly inside the radius needs no test of its points (None
    for never). Crowded cells are opened level by level, on cell rows only. With ``exclude_zero``
    pairs of cells at one and the same place drop out.
    """
    near2, far2 = box_dist2("a", "b", a.box.boxsize)
    r2 = F.lit(float(radius2))
    reach = near2 < r2 if strict else near2 <= r2
    if exclude_zero:
        reach = reach & (far2 > 0)
    inside = far2 < r2 if strict else far2 <= r2
    settled = F.lit(False) if settle is None else inside & settle

    def classify(df):
        return df.filter(reach).withColumn("_settled", settled)

    both_leaf = F.col("a.leaf") & F.col("b.leaf")
    level = classify(neighbour_pairs(a, b, half))
    ka, kb = children(a, "a"), children(b, "b")
    done_inside, done_open = [], []
    for _ in range(max(a.depth, b.depth)):
        level = materialize(level)
        done_inside.append(level.filter("_settled"))
        unsettled = level.filter(~F.col("_settled"))
        done_open.append(unsettled.filter(both_leaf))
        level = classify(split_pairs(unsettled.filter(~both_leaf).drop("_settled"), ka, kb, half))
    level = materialize(level)
    done_inside.append(level.filter("_settled"))
    done_open.append(level.filter(~F.col("_settled")))
    return CellPairs(
        None if settle is None else union_all(done_inside).select("a", "b"),
        union_all(done_open).select("a", "b"),
    )


def _with_d2(joined: DataFrame, box: Box) -> DataFrame:
    return joined.withColumn("d2", dist2([f"a_{c}" for c in X], [f"b_{c}" for c in X], box.boxsize))


def join_points(ids: DataFrame, a: DataFrame, b: DataFrame, box: Box) -> DataFrame:
    """Join leaf id pairs (a_cid, b_cid, tests) with the points of both leaves and add d2.

    The last join is keyed by the leaf of ``a``, and by a part of the leaves of ``b`` where more
    than KEY_TESTS tests share a leaf of ``a``. So a key holds at most ``cap`` rows of ``a`` and,
    but for one leaf pair, about KEY_TESTS tests. The partition count follows from all tests.
    """
    spark = ids.sparkSession
    load = ids.groupBy("a_cid").agg(F.sum("tests").alias("_tests"))
    tests, most = load.agg(F.sum("_tests"), F.max("_tests")).first()
    left = a.selectExpr(*never_null(a.columns, "a_"))
    right = b.selectExpr(*never_null(b.columns, "b_"))
    key = ["a_cid"]
    if (most or 0) > KEY_TESTS:
        key = ["a_cid", "_part"]
        parts = load.select("a_cid", F.ceil(F.col("_tests") / KEY_TESTS).cast("int").alias("_parts"))
        ids = ids.join(parts, "a_cid").withColumn("_part", F.pmod(F.xxhash64("b_cid"), F.col("_parts")).cast("int")).drop("_parts")
        left = left.join(parts, "a_cid").withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)"))).drop("_parts")
    spread = ids.drop("tests").join(right, "b_cid").repartition(tasks_for(spark, tests or 0), *key)
    return _with_d2(spread.join(left, key).drop("_part"), box)


def shipped(ids: DataFrame, points: DataFrame, side: str, n: int) -> DataFrame:
    """The points of one side's leaves, once for every pair of blocks in which a leaf has a partner."""
    cid = f"{side}_cid"
    where = ids.select("a_block", "b_block", cid).distinct()
    return where.join(points.selectExpr(*never_null(points.columns, f"{side}_")), cid).repartition(n, "a_block", "b_block")


def join_blocks(ids: DataFrame, a: DataFrame, b: DataFrame, box: Box, fold: Fold | None = None) -> DataFrame:
    """As ``join_points``, for ids with a_block and b_block; with ``fold`` its sums over the pairs instead of the pairs.

    Both sides and the ids are shuffled by pair of blocks, and joined there without a further shuffle. A key holds at most two blocks of points and the square of a block of tests, however many
    leaves are around; it grows with neither the density nor the radius.
    """
    tests = ids.agg(F.sum("tests")).first()[0] or 0
    if fold is not None:
        return _folded(ids, a, b, fold, tests)
    # Pairs of blocks differ much in tests, so tasks are small.
    n = tasks_for(ids.sparkSession, tests) * 4
    # Rows that lie together by pair of blocks also do by pair of blocks and leaf; Spark shuffles again unless told so.
    ids.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    blocks = ["a_block", "b_block"]
    keyed = ids.drop("tests").repartition(n, *blocks)
    left, right = (shipped(ids, points, side, n).hint("merge") for points, side in ((a, "a"), (b, "b")))
    return _with_d2(keyed.join(left, [*blocks, "a_cid"]).join(right, [*blocks, "b_cid"]).drop(*blocks), box)


def _folded(ids: DataFrame, a: DataFrame, b: DataFrame, fold: Fold, tests: float) -> DataFrame:
    """(ibin, n, moments) of every pair of blocks: a leaf is shipped once to every pair of blocks in which it has a
    partner, and compared there. Work that ships more than a pass may is done in several."""
    blocks = ["a_block", "b_block"]
    # One catalogue has one side, so that a leaf comes once.
    sides = [("a", a, 0)] if fold.auto else [("a", a, 0), ("b", b, 1)]
    ends = [
        ids.select(*blocks, F.lit(0 if fold.auto or x == "a" else 1).alias("side"), F.col(f"{x}_cid").alias("a_cid"), F.col(f"{x}_load").alias("load"))
        for x in "ab"
    ]
    where = materialize(union_all(ends).distinct())
    ends_in, total = where.agg(F.count(F.lit(1)), F.coalesce(F.sum("load"), F.lit(0))).first()
    own = where.select("side", "a_cid", "load").distinct().agg(F.sum("load")).first()[0] or 0
    passes = max(1, math.ceil(total / max(PASS_POINTS, PASS_SHARE * own)))
    # Parts out of reach leave about a quarter of the tests. Pairs of blocks differ much in tests, so tasks are small.
    n = tasks_for(ids.sparkSession, tests / 4 / passes) * 4
    rows = union_all([df.selectExpr(f"{k} AS side", *never_null(["cid", *fold.columns], "a_")) for _, df, k in sides])
    schema = ", ".join(["ibin int", "n decimal(38,0)", *[f"{m} double" for m in fold.moments]])
    turn = F.pmod(F.xxhash64(*blocks), F.lit(passes))
    parts = []
    for k in range(passes):
        pairs = ids.select(*blocks, F.col("a_cid").alias("i"), F.col("b_cid").alias("j"))
        some = where.drop("load")
        if passes > 1:
            pairs, some = pairs.filter(turn == k), some.filter(turn == k)
        if ends_in / passes <= BROADCAST_ROWS:
            # Else the points are shuffled for this join first.
            some = F.broadcast(some)
        # Both stem from one table, and a cogroup wants columns of its own on each.
        joined = some.join(rows, ["side", "a_cid"])
        both = [df.toDF(*df.columns).repartition(n, *blocks).groupBy(*blocks) for df in (pairs, joined)]
        found = both[0].cogroup(both[1]).applyInArrow(folder(fold), schema)
        if passes > 1:
            whole = F.sum("n").cast("decimal(38,0)").alias("n")
            found = materialize(found.groupBy("ibin").agg(whole, *[F.sum(m).alias(m) for m in fold.moments]))
        parts.append(found)
    return union_all(parts)


def pair_ids(pairs: DataFrame, *more: Column) -> DataFrame:
    tests = F.col("a.n").cast("double") * F.col("b.n")
    return pairs.select(
        F.col("a.cid").alias("a_cid"), F.col("b.cid").alias("b_cid"), F.col("a.block").alias("a_block"), F.col("b.block").alias("b_block"),
        tests.alias("tests"), *more,
    )


def point_pairs(
    pairs: DataFrame, a: DataFrame, b: DataFrame, box: Box, radius2: float, strict: bool, half: bool,
    exclude_zero: bool = False,
) -> DataFrame:
    """Point pairs of leaf pairs within the radius: columns a_*, b_* and d2."""
    joined = join_blocks(pair_ids(pairs), a, b, box)
    if half:
        joined = joined.filter((F.col("a_cid") != F.col("b_cid")) | (F.col("a_pid") < F.col("b_pid")))
    r2 = F.lit(float(radius2))
    joined = joined.filter(F.col("d2") < r2 if strict else F.col("d2") <= r2)
    return joined.filter("d2 > 0") if exclude_zero else joined


def fold_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, box: Box, fold: Fold) -> DataFrame:
    """Sums of ``fold`` over the point pairs of leaf pairs: rows (ibin, n, moments), several for a shell."""
    loads = []
    for x in "ab":
        load = "load" if "load" in pairs.schema[x].dataType.names else "n"
        loads.append(F.col(f"{x}.{load}").alias(f"{x}_load"))
    return join_blocks(pair_ids(pairs, *loads), a, b, box, fold)
