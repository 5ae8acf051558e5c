"""Mean velocity of the particles in a sphere around every particle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import V, X, wrap
from boxstats.operators.joins import lookup_join
from boxstats.operators.tree import (
    base_side,
    build_tree,
    cell_pairs,
    distinct_positions,
    point_pairs,
)
from boxstats.storage import materialize

LEAF_CAP = 256


def smooth_velocity(points: DataFrame, box: Box, radius: float, cap: int = LEAF_CAP) -> DataFrame:
    """pid, x0..x2, vs0..vs2, n_near: mean of v over d <= radius, the particle itself included.

    Cells that lie wholly within the radius of all of a target cell add their totals once
    for the cell; only the remaining leaf pairs are compared point by point.
    """
    if not radius > 0:
        raise ValueError("the smoothing radius must be positive")
    pos = distinct_positions(points, box, {f"s{i}": F.col(v) for i, v in enumerate(V)})
    totals = {"cnt": F.col("w"), **{f"s{i}": F.col(f"s{i}") for i in range(3)}}
    tree = build_tree(pos, box, base_side(box, radius, pos.rows), cap, totals)
    found = cell_pairs(tree, tree, radius * radius, strict=False, half=False, settle=F.lit(True))

    near = point_pairs(
        found.open,
        tree.points.select("cid", "pid", *X),
        tree.points.select("cid", *X, "w", "s0", "s1", "s2"),
        box,
        radius * radius,
        strict=False,
        half=False,
    )
    tested = near.groupBy("a_cid", "a_pid").agg(
        F.sum("b_w").alias("n"), *[F.sum(f"b_s{i}").alias(f"s{i}") for i in range(3)]
    )

    # Totals settled for a cell hold for every leaf below it.
    inside = found.inside.groupBy(F.col("a.cid").alias("anc")).agg(
        F.sum("b.cnt").alias("n"), *[F.sum(f"b.s{i}").alias(f"s{i}") for i in range(3)]
    )
    if tree.depth == 0:
        below = inside.withColumnRenamed("anc", "cid")
    else:
        below = lookup_join(tree.ancestors(), materialize(inside), ["anc"])
    whole = below.groupBy("cid").agg(
        F.sum("n").alias("n_in"), *[F.sum(f"s{i}").alias(f"s{i}_in") for i in range(3)]
    )

    def total(c):
        return F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_in", F.lit(0))

    combined = (
        tree.points.select("cid", "pid", *X)
        .join(tested.withColumnsRenamed({"a_cid": "cid", "a_pid": "pid"}), ["cid", "pid"], "left")
        .join(whole, "cid", "left")
        .withColumns({c: total(c) for c in ("n", "s0", "s1", "s2")})
        .select("pid", *X, *[(F.col(f"s{i}") / F.col("n")).alias(f"vs{i}") for i in range(3)], F.col("n").alias("n_near"))
    )
    if not pos.has_copies:
        return combined
    members = points.select("pid", *[wrap(F.col(c).cast("double"), box.boxsize).alias(c) for c in X])
    return lookup_join(members, materialize(combined.drop("pid")), list(X)).select(
        "pid", *X, "vs0", "vs1", "vs2", "n_near"
    )
