"""The run ledger as a stream: windowed counts, bursts of edits, decisions kept by key, and fold state per session.

The definitions have an append-only ledger and a debounced watcher; event-time windows and watermarks are this engine's addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "at timestamp, file string, sha string, elapsed double, parsed boolean, nodes int, edges int, faults int, looks int, checks map<string,int>"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RUN).json(folder)


def windowed(stream: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n): events in each window; closed windows come out once the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def bursts(stream: DataFrame, at: str, key: str, delay: str = "250 milliseconds", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events closer than the delay are one burst, which is what a debounced watcher acts on."""
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, delay), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, sha: str = "sha") -> DataFrame:
    """Work that is keyed by content is done once."""
    return stream.dropDuplicates([sha])


def keep_latest(folder: str, key: str, order: str):
    """For foreachBatch: the latest row of each key, as one snapshot folder per batch. A batch that is run again writes the same snapshot."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = f"{folder}/epoch={epoch - 1}"
        try:
            held = spark.read.parquet(earlier)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = batch.limit(0)
        every = held.unionByName(batch)
        columns = [c for c in every.columns if c != key]
        latest = every.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return write


def folded(actions: DataFrame, session: str = "session") -> DataFrame:
    """(session, collapsed, depth): the fold state after a stream of (session, action, target) rows. expandAll and collapseAll
    replace the state, depth sets how far it is open, toggle folds or unfolds one target."""

    def reduce(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        collapsed, depth = state.get if state.exists else ("", -1)
        closed = set(filter(None, collapsed.split("\x1f")))
        for f in frames:
            for action, target in zip(f["action"], f["target"], strict=True):
                if action == "expandAll":
                    closed, depth = set(), -1
                elif action == "collapseAll":
                    closed, depth = set(), 0
                elif action == "depth":
                    closed, depth = set(), int(target)
                elif action == "toggle":
                    closed ^= {target}
        state.update(("\x1f".join(sorted(closed)), depth))
        yield pd.DataFrame({"session": [key[0]], "collapsed": [sorted(closed)], "depth": [depth]})

    return actions.groupBy(session).applyInPandasWithState(reduce, "session string, collapsed array<string>, depth int", "collapsed string, depth int", "update", "NoTimeout")
