"""Exact duplicates by a heavy-hitter split.

Digests of the texts are counted with Misra-Gries sketches, one per input partition. The sketches' candidates are verified
by an exact count; the verified winners, whose number has a bound, are broadcast, and their rows are settled where they
are read. All other digests are grouped by an ordinary shuffle with partial aggregation.

Defined results: a null text is empty; of rows with equal texts the largest id stays; null ids rank below all others; rows
that repeat the id and the text that stay are one document, all marked as kept, and `deduplicated` returns one of them. An
empty table gives an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: A digest is a heavy hitter from this share of all rows: at most 1 / SHARE winners of about 60 bytes are broadcast.
SHARE = 0.001


def misra_gries(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """(value, count) of one sketch per partition; a count is too low by at most rows / (counters + 1)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            if len(counts) > counters:
                cut = nlargest(counters + 1, counts.values())[-1]
                counts = {v: c - cut for v, c in counts.items() if c > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["value", "n"])

    return digests.select(column).mapInArrow(sketch, "value binary, n long")


def heavy_groups(digests: DataFrame, share: float = SHARE) -> DataFrame:
    """(digest, keep_id, group_size) of the digests of at least `share` of all rows, and at least two."""
    least = max(2.0, share * digests.count())
    counted = misra_gries(digests, "digest", int(2 / share)).groupBy("value").agg(F.sum("n").alias("n"))
    candidates = counted.filter(F.col("n") >= min(least / 2, least - 1)).select(F.col("value").alias("digest"))
    exact = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return saved(exact.filter(F.col("group_size") >= least), "winners")


def digest_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of docs: its id (as `doc_id`), keep_id, group_size, kept, text_sha256."""
    digests = saved(digest_table(docs, id_col, text_col), "digests")
    heavy = F.broadcast(heavy_groups(digests, share))
    common = digests.join(heavy, "digest")
    rest = digests.join(heavy, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    every = common.unionByName(rest.join(groups, "digest"))
    return every.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs that stay, one per distinct text, with all their columns."""
    digests = saved(digest_table(docs, id_col, text_col), "digests")
    heavy = F.broadcast(heavy_groups(digests, share))
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing names can't meet the operator's own
    rows = docs.withColumns({"__id": F.col(id_col), "__digest": F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256))})
    rows = rows.toDF(*names, "id", "digest")
    kept_heavy = rows.join(heavy.drop("group_size"), "digest").filter(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    groups = digests.join(heavy.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.max("id").alias("keep_id"))
    kept_rest = rest.join(groups, "digest").filter(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    return kept_heavy.unionByName(kept_rest).select(*names).toDF(*docs.columns)


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
