"""Written intermediate tables for iterative operators.

A table in the folder named by ``spark.checkpoint.dir`` cuts the lineage and outlives any
executor. Only a local session without that setting, as in tests, falls back to a folder of its own.
Rounds of an iteration discard the tables of the round before; tables that a result may still read
stay until the folder is cleaned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    path = spark.conf.get(_SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="boxstats-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back. Spark deletes the shuffle files of the write when it is done."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/boxstats-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def materialize_observed(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates of the rows that the write itself observes, in no job of their own."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(name) for name, c in facts.items()]))
    return table, seen.get


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and that nothing reads any more."""
    path = getattr(table, "_written_to", None)
    if path:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
