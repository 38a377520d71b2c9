"""The run ledger in batch: rounds, bursts, profiles over time. The streaming forms are in enthyme.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounds(runs: DataFrame, key: str, kind: str, order: tuple[str, ...]) -> DataFrame:
    """(key, rounds, first_type, last_type, kinds) of each file's or user's runs, in order."""
    o = F.struct(*order)
    return runs.groupBy(key).agg(F.count("*").alias("rounds"), F.min_by(kind, o).alias("first_type"), F.max_by(kind, o).alias("last_type"), F.count_distinct(kind).alias("kinds"))


def debounced(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """(key, bursts, events): events closer than the delay are one burst."""
    w = Window.partitionBy(key).orderBy(at, tie)
    s = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    gap = F.col("s") - F.lag("s").over(w)
    return events.select(key, at, tie, s.alias("s")).withColumn("gap", gap).groupBy(key).agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > seconds)).alias("bursts"), F.count("*").alias("events"))


def profile(events: DataFrame, at: str, weight: str, bins: int) -> DataFrame:
    """(bin, weight, smooth): a weighted histogram over the whole span, with 1-2-1 smoothing. The bins, not the events, meet in a window."""
    s = events.select((F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("s"), F.col(weight).alias("w"))
    span = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    binned = s.join(F.broadcast(span), how="cross").select(F.least(F.lit(bins - 1), F.floor((F.col("s") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int").alias("bin"), "w")
    held = binned.groupBy("bin").agg(F.sum("w").alias("weight"))
    every = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(held, "bin", "left").select("bin", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    smooth = (F.coalesce(F.lag("weight").over(w), "weight") + 2 * F.col("weight") + F.coalesce(F.lead("weight").over(w), "weight")) / 4
    return every.withColumn("smooth", smooth)
