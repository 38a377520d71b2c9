"""Claims that join two distant passages of their source without a mark.

A claim meets its own source only, and each pair is read by itself. What they share is found by seeds and extended. Seeds of a claim of up to FEW of them are its
runs of GRAM characters at every RUN - GRAM + 1st place, looked up in the source; in longer ones, the runs whose hash is the smallest among those of RUN
characters, in both. Either way every stretch of RUN characters that both have holds one, so no stretch is missed. A
seed names a diagonal, on which the stretches of RUN characters or more are read off. In each claim the longest stretch holds first, then the longest
before it and after it in both texts, and so on.

Defined results: null texts share nothing; claims with an elision, a note or fewer than two RUN characters are left out; of equal stretches
the one that comes first in the claim, then in the source, holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..plans.tables import materialised
from .places import shaped

#: A run that counts, the gap from which two are a splice, the share of a claim that must be its source's, characters shown of a run.
RUN, GAP, SHARE, SHOWN = 40, 120, 0.6, 46
GRAM = 16
#: Seeds of a claim that are looked up one by one.
FEW = 32


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def seeds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the seeds of a text."""
    p = points(text).astype(np.uint64)
    n = len(p) - GRAM + 1
    if n < RUN - GRAM + 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = (h + p[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    views = np.lib.stride_tricks.sliding_window_view(h, RUN - GRAM + 1)
    at = np.unique(np.concatenate([views[k : k + 65536].argmin(axis=1) for k in range(0, len(views), 65536)]) + np.arange(len(views)))
    return h[at].view(np.int64), at


def diagonals(claim: str, body: str) -> np.ndarray:
    """Places in the body less places in the claim of the seeds that both hold."""
    step = RUN - GRAM + 1
    if len(claim) <= FEW * step:
        found = set()
        for a in range(0, len(claim) - GRAM + 1, step):
            gram, at = claim[a : a + GRAM], -1
            while (at := body.find(gram, at + 1)) >= 0:
                found.add(at - a)
        return np.array(sorted(found), dtype=np.int64)
    (mine, a), (theirs, b) = seeds(claim), seeds(body)
    order = np.argsort(mine, kind="stable")
    lo, hi = (np.searchsorted(mine[order], theirs, side) for side in ("left", "right"))
    n = hi - lo
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.unique(np.repeat(b, n) - a[order[entry]])


def stretches(claim: str, body: str) -> np.ndarray:
    """(a, b, size), a row for each stretch of RUN characters or more on the diagonals, places from 0."""
    found, out = diagonals(claim, body), [np.empty((0, 3), dtype=np.int64)]
    if len(found):
        x, y = points(claim), points(body)
        wide = len(x) + 2
        many = max(1, (1 << 20) // wide)
        for k in range(0, len(found), many):
            d = found[k : k + many]
            at = d[:, None] + np.arange(len(x))
            same = np.zeros((len(d), wide), dtype=bool)
            same[:, 1:-1] = (at >= 0) & (at < len(y)) & (y[np.clip(at, 0, len(y) - 1)] == x)
            flat = same.ravel()
            turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
            size = turns[1::2] - turns[::2]
            row, a = np.divmod(turns[::2][size >= RUN], wide)
            out.append(np.stack([a - 1, a - 1 + d[row], size[size >= RUN]], axis=1))
    return np.concatenate(out)


def in_order(found: np.ndarray) -> list[list[int]]:
    """The stretches that hold, longest first: after each pick what is left lies before it in both texts, or after it in both, and is cut to that."""
    kept, parts = [], [found]
    while parts:
        rest = parts.pop()
        if len(rest) < 2:
            kept += rest.tolist()
            continue
        a, b, size = rest.T
        k = np.lexsort((b, a, -size))[0]
        kept.append(rest[k].tolist())
        before = np.minimum(size, np.minimum(a[k] - a, b[k] - b))
        skip = np.maximum(0, np.maximum(a[k] + size[k] - a, b[k] + size[k] - b))
        for part in (np.stack([a, b, before], axis=1), np.stack([a + skip, b + skip, size - skip], axis=1)):
            parts.append(part[part[:, 2] >= RUN])
    return kept


def runs_held(pairs: DataFrame) -> DataFrame:
    """(claim_id, a, b, size) of pairs (claim_id, claim, body): the stretches of each claim that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, (claim, body) in enumerate(zip(batch.column("claim"), batch.column("body"), strict=True)) for x in in_order(stretches(claim.as_py(), body.as_py()))]
            which, a, b, size = ([r[k] for r in rows] for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("claim_id").take(pa.array(which, pa.int64())), *(pa.array(c, pa.int32()) for c in (a, b, size))], ["claim_id", "a", "b", "size"])

    return pairs.mapInArrow(run, f"claim_id {pairs.schema['claim_id'].dataType.simpleString()}, a int, b int, size int")


def spliced(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, gap, left, right) of claims (claim_id, source_id, text, note) on sources (source_id, text): the first two runs of a claim that
    stand GAP characters or more apart in its source, where the runs make up SHARE of it."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(^|\s)#[A-Za-z][\w-]*", " "))
    marked = F.contains(said, F.lit("...")) | F.contains(said, F.lit("…")) | F.col("note").isNotNull()
    asked = claims.filter(~marked & (F.length(said) >= 2 * RUN)).select("claim_id", "source_id", F.lower(F.translate(normalise(said), "İ", "I")).alias("claim"))
    body = sources.select("source_id", F.lower(shaped(F.col("text"))).alias("body"))
    asked = materialised(asked)
    kept = materialised(runs_held(asked.join(body, "source_id").select("claim_id", "claim", "body")))
    w = Window.partitionBy("claim_id").orderBy("a")
    joins = kept.withColumn("gap", F.lead("b").over(w) - F.col("b") - F.col("size")).withColumn("next_a", F.lead("a").over(w)).withColumn("next_size", F.lead("size").over(w))
    covered = kept.groupBy("claim_id").agg(F.sum("size").alias("covered"))
    first = joins.filter(F.col("gap") >= GAP).groupBy("claim_id").agg(F.min(F.struct("a", "size", "gap", "next_a", "next_size")).alias("j")).select("claim_id", "j.*")
    rows = first.join(covered, "claim_id").join(asked, "claim_id").filter(F.col("covered") >= SHARE * F.length("claim"))
    left = F.substring(F.col("claim"), F.col("a") + 1 + F.greatest(F.lit(0), F.col("size") - SHOWN), F.least(F.col("size"), F.lit(SHOWN)))
    return rows.select("claim_id", "gap", left.alias("left"), F.substring(F.col("claim"), F.col("next_a") + 1, F.least(F.col("next_size"), F.lit(SHOWN))).alias("right"))
