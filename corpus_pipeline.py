"""A training corpus from ``documents``: five stages, each by one operator of ``boxstats.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the first
four return the columns of ``docs`` whatever they are. Null and empty texts fail the quality rules;
stages that meet them on their own leave them as they are. Rows without doc_id, and rows that share
one, are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.llm import jaccard, mixing, packing, quality, suffixes
from boxstats.llm.text import short_batches
from boxstats.storage import materialize

#: Tables of ids up to this number of rows are broadcast (16 bytes each), larger ones shuffled.
BROADCAST_ROWS = 250_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the quality classifier keep."""
    short_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, rows without one last.

    Rows are known by a written number, so rows that share a doc_id stand for themselves.
    """
    short_batches(spark)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = materialize(jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text")))
    # Only rows with links have company.
    linked = groups.filter("n_links > 0").select(F.col("doc_id").alias("_row"), "class_id").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stays = linked.groupBy("class_id").agg(F.min(order).alias("_first")).select(F.col("_first._row").alias("_row"))
    gone = materialize(linked.select("_row").join(stays, "_row", "left_anti"))
    return rows.join(_small(gone, gone.count()), "_row", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of long strings that occur elsewhere. ``n_chars`` follows the text."""
    short_batches(spark)
    others = tuple(c for c in docs.columns if c != "text")
    cut = suffixes.dedup(docs, carry=others)
    rows = cut.select("rest", F.col("kept_text").alias("text"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            columns.append(F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("rest").getField(name).alias(name))
    return rows.select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as many times as each is taken."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    mixed = mixing.mix(rows, carry=("_row",)).filter("taken > 0")
    times = materialize(mixed.select("_row", (F.col("taken") / F.col("size")).cast("int").alias("_times")))
    met = rows.join(_small(times, times.count()), "_row")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The first stage is a trained classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
