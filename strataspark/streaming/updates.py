"""Streams: incremental posteriors and event windows.

The posterior's sums are additive, so a stream folds in new observations
exactly once; each micro-batch is one version of the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bayes import merge, sums_table
from ..sources.tables import snapshot, versions


def fold_posterior(observations: DataFrame, to_pairs: Callable[[DataFrame], DataFrame], root: str, keys: list[str], id_column: str, time_column: str, delay: str = "7 days"):
    """A streaming writer of versions (keys, tau, tau_y) under ``root``; ids repeated within the delay count once.

    A version holds the batch it came from, so a batch that is run again
    after a failure isn't folded in twice.
    """
    once = observations.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([id_column])

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        found = versions(spark, root)
        new = sums_table(to_pairs(df), keys)
        if found:
            state = spark.read.parquet(f"{root}/version={found[-1]}")
            last = state.agg(F.max("batch")).first()[0]
            if last is not None and last >= batch_id:
                return
            new = merge(state, new, keys)
        snapshot(new.withColumn("batch", F.lit(batch_id).cast("long")), root)

    return once.writeStream.foreachBatch(batch)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Count and sum per window; with ``delay`` late rows are dropped on a stream."""
    if delay:
        events = events.withWatermark(time, delay)
    g = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, value: str, delay: str | None = None) -> DataFrame:
    if delay:
        events = events.withWatermark(time, delay)
    g = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("start"), "n", "total")
