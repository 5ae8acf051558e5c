"""Friends-of-friends groups, halo catalogue and group velocities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES, V, X, box_dist2, min_image, wrap
from boxstats.operators.components import connected_components
from boxstats.operators.joins import lookup_join
from boxstats.operators.tree import (
    Tree,
    base_side,
    build_tree,
    children,
    distinct_positions,
    neighbour_pairs,
    point_pairs,
    split_pairs,
    union_all,
)
from boxstats.storage import materialize

LEAF_CAP = 64


def linking_length(box: Box, n_total: int, b: float = 0.2) -> float:
    """``b`` times the mean separation of ``n_total`` particles."""
    return b * box.boxsize / n_total ** (1.0 / 3.0)


def _cell_links(tree: Tree, link2: float) -> tuple[DataFrame, DataFrame]:
    """Edges between solid cells, and the leaf pairs whose points remain to be compared.

    A cell is solid if all its points link to each other; it is named by its smallest pid.
    Two solid cells are settled by the first pair of subcells that is wholly within reach,
    and then drop out of the search.
    """
    size = tree.box.boxsize

    def solid(name):
        _, diagonal2 = box_dist2(name, name, size)
        return F.when(diagonal2 < F.lit(link2), F.col(name)["rep"])

    near2, far2 = box_dist2("a", "b", size)
    level = neighbour_pairs(tree, tree, half=True).withColumns({"sa": solid("a"), "sb": solid("b")})
    below = children(tree, "c")
    edges, leaf_pairs = [], []
    for step in range(tree.depth + 1):
        level = materialize(level.filter(near2 < F.lit(link2)).withColumn("inside", far2 < F.lit(link2)))
        linked = level.filter("inside and sa != sb").select("sa", "sb").distinct()
        edges.append(linked)
        rest = level.filter("sa is null or sb is null or (sa != sb and not inside)")
        # Only pairs of two solid cells can drop out; the others have no names to join on.
        named = "sa is not null and sb is not null"
        kept = rest.filter(named).join(linked, ["sa", "sb"], "left_anti").select("a", "b", "sa", "sb")
        rest = kept.unionByName(rest.filter(f"not ({named})").select("a", "b", "sa", "sb"))
        both_leaf = F.col("a.leaf") & F.col("b.leaf")
        leaf_pairs.append(rest.filter(both_leaf).select("a", "b"))
        if step < tree.depth:
            level = split_pairs(rest.filter(~both_leaf), below, below, half=True).withColumns(
                {"sa": F.coalesce("sa", solid("a")), "sb": F.coalesce("sb", solid("b"))}
            )
    return union_all(edges).toDF("src", "dst"), union_all(leaf_pairs)


def fof_groups(points: DataFrame, box: Box, link: float, cap: int = LEAF_CAP) -> DataFrame:
    """(pid, gid): gid is the smallest pid of the group; particles link at d < link.

    Graph nodes are solid leaf cells and the points of the other leaves, so a dense clump
    contributes a handful of nodes and edges and not its pairs.
    """
    if not link > 0:
        raise ValueError("the linking length must be positive")
    link2 = link * link
    pos = distinct_positions(points, box)
    tree = build_tree(pos, box, base_side(box, link, pos.rows), cap)
    cell_edges, leaf_pairs = _cell_links(tree, link2)

    _, diagonal2 = box_dist2("c", "c", box.boxsize)
    leaf_rep = tree.cells.filter("leaf").select("cid", tree.cell_struct("c")).filter(diagonal2 < F.lit(link2))
    nodes = materialize(
        tree.points.join(leaf_rep.select("cid", F.col("c.rep").alias("rep")), "cid", "left").select(
            "cid", *X, "pid", F.coalesce("rep", "pid").alias("node")
        )
    )
    close = point_pairs(leaf_pairs, nodes, nodes, box, link2, strict=True, half=True)
    # Edges are told by a cell that they lie in, so that those of one region are contracted together.
    edges = [
        cell_edges.withColumn("near", F.lit(0).cast("bigint")),
        close.select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"), F.col("a_cid").alias("near")),
    ]
    if tree.depth > 0:
        # A solid cell above leaf level ties its leaves together.
        parents = tree.cells.filter("not leaf").select(F.col("cid").alias("anc"), tree.cell_struct("c"))
        solid = parents.filter(diagonal2 < F.lit(link2)).select("anc", F.col("c.rep").alias("src"))
        leaves = tree.cells.filter("leaf").select("cid", F.col("rep").alias("dst"))
        edges.append(lookup_join(tree.ancestors(), solid, ["anc"]).join(leaves, "cid").select("src", "dst", F.col("cid").alias("near")))
    components = connected_components(union_all(edges)).withColumnRenamed("id", "node")
    labels = nodes.join(components, "node", "left").select("pid", *X, F.coalesce("comp", "node").alias("gid"))
    if not pos.has_copies:
        return labels.select("pid", "gid")
    members = points.select("pid", *[wrap(F.col(c).cast("double"), box.boxsize).alias(c) for c in X])
    return lookup_join(members, materialize(labels.drop("pid")), list(X)).select("pid", "gid")


def _members(points: DataFrame, groups: DataFrame) -> DataFrame:
    return materialize(points.select("pid", *X, *V).join(groups, "pid"))


def fof_halos(points: DataFrame, groups: DataFrame, box: Box) -> DataFrame:
    """gid, nfof, centre x0..x2 and mean velocity v0..v2 of every group.

    The centre averages nearest-image offsets from the member with the smallest pid.
    """
    members = _members(points, groups)
    anchor = members.filter("pid = gid").select("gid", *[F.col(x).alias(f"a{i}") for i, x in enumerate(X)])
    offsets = lookup_join(members, anchor, ["gid"], table_rows=anchor.count()).select(
        "gid",
        *[f"a{i}" for i in AXES],
        *V,
        *[min_image(F.col(x) - F.col(f"a{i}"), box.boxsize).alias(f"d{i}") for i, x in enumerate(X)],
    )
    sums = offsets.groupBy("gid").agg(
        F.count(F.lit(1)).alias("nfof"),
        *[F.min(f"a{i}").alias(f"a{i}") for i in AXES],
        *[F.avg(f"d{i}").alias(f"d{i}") for i in AXES],
        *[F.avg(v).alias(v) for v in V],
    )
    centre = [wrap(F.col(f"a{i}") + F.col(f"d{i}"), box.boxsize).alias(f"x{i}") for i in AXES]
    return sums.select("gid", "nfof", *centre, *V)


def group_velocity(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Replace every velocity by the mean of its group; pid, gid and positions are kept."""
    members = _members(points, groups)
    means = members.groupBy("gid").agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(V)])
    means = materialize(means)
    joined = lookup_join(members.drop(*V), means, ["gid"], table_rows=means.count())
    return joined.select("pid", "gid", *X, *[F.col(f"m{i}").alias(v) for i, v in enumerate(V)])
