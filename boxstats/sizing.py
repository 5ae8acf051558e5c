"""Partition counts from the work of a stage where its input bytes say little about it."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Elementary steps (pair tests, cosines) that make a task of a few seconds.
STEPS_PER_TASK = 100_000_000


def tasks_for(spark: SparkSession, steps: float) -> int:
    """At least one task per core, more as the work grows."""
    cores = spark.sparkContext.defaultParallelism
    return int(max(cores, min(steps / STEPS_PER_TASK + 1, 2**31 - 1)))
