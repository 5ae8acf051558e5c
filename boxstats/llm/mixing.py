"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is shuffled by a hash of doc_id and given virtual finish times: the tokens of the
source so far, over the target of the source. All documents are then sorted by virtual time and
cut where the total budget is used up. A source whose target exceeds its size comes round again,
up to ``max_epochs`` times, since a target never exceeds that many times the size.

Running sums never need one task per source: hashes and times fall into buckets of about
``ROWS_PER_BUCKET`` rows, sums of buckets are small, and only rows of one bucket are sorted
together. Sources are assumed to be labels, far fewer than rows; their totals make one small table.

Null texts have size 0. Documents of size 0 take no part and get 0. A null source is a source
of its own, last in order. Repeated doc_id are separate documents with equal hashes; they are
told apart by their size and place in the running sums. Long texts are sizes like others; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.storage import materialize

ROWS_PER_BUCKET = 5_000
#: Ranges that one look at virtual times tells apart.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> target: shares by weight, held at ``max_epochs`` times the size.

    The level that fills the budget is found in closed form: sources in the order of limit over
    weight, of which a prefix is held at its limit and the rest shares by weight what remains.
    """
    order = Window.orderBy(F.col("source").isNull(), F.expr("hex(source)"))
    cap = F.col("source_size") * max_epochs
    rows = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumns(
        {"_w": F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")), "_cap": cap}
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        }
    )
    # The first source that stays below its limit fixes the level of all that follow it.
    share = F.col("_left").cast("double") / F.col("_weight").cast("double")
    level = F.min(F.when(F.col("_w") * share <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_i", share.alias("level")))).over(everything)
    rows = rows.withColumn("_level", level["level"])
    fair = F.col("_w") * F.col("_level")
    return rows.select("source", "source_size", F.when(fair.isNull() | (fair > F.col("_cap")), F.col("_cap").cast("double")).otherwise(fair).alias("target"))


def mix(docs: DataFrame, size_column: str | None = None, max_epochs: int = 3, seed: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and text (or a size column) -> doc_id, source, size, source_size, target, taken
    and the columns named in ``carry``."""
    size = word_count(F.col("text").cast("string")) if size_column is None else F.coalesce(F.col(size_column).cast("long"), F.lit(0))
    rows = materialize(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), *carry))
    # The digest of the id is the same in other engines.
    rows = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    n = rows.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / 2.0**32).cast("long"))
    # One row per source and bucket: the running sums of buckets and the totals of sources.
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("source", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), "_n"))
    total = sums.groupBy("source").agg(F.sum("_n").alias("source_size"))
    plan = materialize(targets(total, max_epochs))
    plan_rows = plan.count()
    small = (lambda t, k: F.broadcast(t) if k <= 100_000 else t)
    facts = sums.join(small(plan, plan_rows), sums["source"].eqNullSafe(plan["source"])).select(
        sums["source"].alias("_s"), F.col("_b").alias("_sb"), "_ahead", "source_size", "target"
    )
    rows = rows.join(
        small(facts, plan_rows * buckets), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb"))
    ).drop("_s", "_sb")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_ahead") + F.sum("size").over(inside))
    rows = materialize(rows.select("doc_id", "source", "size", "source_size", "target", "_h", "_cum", *carry))
    # Rounds that start before the source's target, with one more for what the cut may reach.
    rounds = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")) + 2).cast("int")
    items = rows.filter("size > 0 AND target > 0").select(
        "source", "doc_id", "size", "_h", "_cum", "source_size", "target", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("_round")
    )
    items = items.withColumn("_time", (F.col("_round") * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target"))
    # Budget: the targets add up to all sizes, so the cut lies close to time 1.
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    kept = _cut(items, budget).withColumn("_one", F.lit(1))
    taken = kept.groupBy("source", "doc_id", "size", "_cum").agg(F.sum("_one").alias("_times"))
    taken = taken.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("_cum").alias("_c"), F.col("size").alias("_z"), "_times")
    joined = rows.join(
        taken,
        rows["doc_id"].eqNullSafe(F.col("_d")) & rows["source"].eqNullSafe(F.col("_s")) & (rows["_cum"] == F.col("_c")) & (rows["size"] == F.col("_z")),
        "left",
    )
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"), *carry)


def _cut(items: DataFrame, budget: int) -> DataFrame:
    """The items of lowest (virtual time, source, hash, id) whose running size stays in the budget.

    A histogram over ranges of time finds the range in which the budget ends, and again within that
    range, until it holds so few rows that one task sorts them. All ranges before it are kept whole.
    """
    part = F.least(F.col("_time") / 4, F.lit(1 - 2.0**-52))
    same, before, base = F.lit(True), F.lit(False), 0
    while True:
        step = F.floor(part * RANGES)
        found = items.filter(same).groupBy(step.alias("_t")).agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_rows"))
        running = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
        at = found.withColumn("_upto", F.sum("_n").over(running)).filter(F.col("_upto") > budget - base).orderBy("_t").first()
        if at is None:
            return items.filter(same | before)
        before = before | (same & (step < at["_t"]))
        same = same & (step == at["_t"])
        base += at["_upto"] - at["_n"]
        single = items.filter(same).agg(F.countDistinct("_time")).first()[0] == 1
        if at["_rows"] <= ROWS_PER_BUCKET or single:
            break
        part = part * RANGES - step
    exact = Window.orderBy("_time", F.col("source").isNull(), F.expr("hex(source)"), "_h", "doc_id", "size", "_round").rowsBetween(Window.unboundedPreceding, 0)
    inside = items.filter(same).withColumn("_upto", F.sum("size").over(exact) + base).filter(F.col("_upto") <= budget).drop("_upto")
    return items.filter(before).unionByName(inside)
