"""Mixing sources to target weights by Pfair scheduling; DataFrame and SQL functions only.

Every source's rows are dealt into blocks of BLOCK_ROWS. A source of weight w has its i-th block released at slot
floor((i - 1) / w) and due by slot ceil(i / w). Earliest deadline first, one block per slot, meets every window, so after
any number of slots a source has had its weight's share to within less than one block. Weights are exact fractions (a float
is the decimal that it prints as), so the schedule repeats after as many slots as their common denominator says; one period
is worked out ahead, and a row finds its slot from its rank by arithmetic. When a source has no blocks left, the others go on with their weights scaled up, from that slot: no row is dropped.

Ranks are not taken in one task per source: rows are dealt by a hash into buckets of about BUCKET_ROWS, ranked there, and
moved up by the counts of the buckets before, so a source with a third of all rows is ranked by many tasks.

Defined results: a null source is a source of its own, called null; without weights, a source weighs as the root of its
number of rows, in whole thousandths or less (`shares`); sources without a given weight, or with weight 0, come after the others,
in proportion to their rows, rounded likewise. Rows with equal ids are ranked by their other columns; rows that are equal
altogether in any order. Weights and sources are settings, not data, and the plan for them is made on the driver: weights
without a common denominator of MOST_SLOTS or less raise ValueError, as do more than MOST_SOURCES sources; nothing is rounded or left
out instead. An empty table gives an empty result. Extra columns are carried along whatever their names.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction
from math import lcm, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div

BLOCK_ROWS, BUCKET_ROWS, MOST_SOURCES, MOST_SLOTS = 64, 4_000, 10_000, 100_000
#: Weights that are not given are multiples of one of so many parts.
SHARES = 1000


def shares(weights: dict[str, float], q: int) -> dict[str, int]:
    """Whole numbers in proportion to the weights, at least 1, with sum q (largest remainders)."""
    total = sum(weights.values())
    out = {k: max(1, int(q * w / total)) for k, w in weights.items()}
    order = sorted(weights, key=lambda k: (out[k] - q * weights[k] / total, k))
    while (left := q - sum(out.values())) != 0:
        for k in order if left > 0 else [k for k in reversed(order) if out[k] > 1]:
            if left == 0:
                break
            out[k] += 1 if left > 0 else -1
            left -= 1 if left > 0 else -1
    return out


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(parts) slots: earliest deadline first among the released blocks."""
    q = sum(parts.values())
    waiting = sorted((((i - 1) * q // n, ceil_div(i * q, n), k) for k, n in parts.items() for i in range(1, n + 1)), reverse=True)
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {k: [] for k in parts}
    for slot in range(q):
        while waiting and waiting[-1][0] <= slot:
            _, due, k = waiting.pop()
            heapq.heappush(ready, (due, k))
        slots[heapq.heappop(ready)[1]].append(slot)
    return slots


def exact(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights, the smallest; their sum is the period."""
    given = {k: Fraction(str(w)) for k, w in weights.items()}
    total = sum(given.values())
    q = lcm(*((w / total).denominator for w in given.values()))
    if q > MOST_SLOTS:
        raise ValueError(f"the weights repeat only after {q} slots; give weights with a common denominator of {MOST_SLOTS} or less")
    return {k: int(w / total * q) for k, w in given.items()}


def rounded(weights: dict[str, float]) -> dict[str, int]:
    return shares(weights, max(SHARES, 10 * len(weights))) if weights else {}


def phases(blocks: dict[str, int], weights: dict[str, float | Fraction]) -> list[dict]:
    """For each source and phase: the first and last block (from 0), the slot at which the phase begins, its period, and
    the source's slots in a period."""
    left, done, begin, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    given = {k: w for k, w in weights.items() if w > 0}
    while left:
        active = {k: given[k] for k in left if k in given}
        parts = exact(active) if active else rounded({k: float(n) for k, n in left.items()})
        slots, q = period(parts), sum(parts.values())
        end = min((left[k] - 1) // len(slots[k]) * q + slots[k][(left[k] - 1) % len(slots[k])] for k in parts) + 1
        for k in parts:
            whole, rest = divmod(end, q)
            n = whole * len(slots[k]) + sum(s < rest for s in slots[k])
            if n:
                out.append({"source": k, "first": done[k], "last": done[k] + n - 1, "begin": begin, "q": q, "slots": slots[k], "share": parts[k] / q})
            done[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}
        begin += end
    return out


def keyed(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mixed_rows(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs with mix_slot, mix_seat (its place in the block), mix_block (of its source) and mix_weight (what its source has in
    that phase). Order by (mix_slot, mix_seat) to read the mixture."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.withColumns({"__k": keyed(F.col(source_col)), "__id": F.col(id_col)}).toDF(*names, "k", "id")
    whole = F.xxhash64(*(n for n, (_, kind) in zip(names, docs.dtypes, strict=True) if "map<" not in kind and kind != "variant"))
    counts = {r.k: r.n for r in rows.groupBy("k").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    target = rounded({k: sqrt(n) for k, n in counts.items()}) if weights is None else {"null" if k is None else f"={k}": w for k, w in weights.items()}
    plan = phases({k: ceil_div(n, block_rows) for k, n in counts.items()}, target)
    per_source = [{"k": k, "buckets": ceil_div(n, bucket_rows), "phases": [p for p in plan if p["source"] == k]} for k, n in sorted(counts.items())]
    schema = "array<struct<k: string, buckets: int, phases: array<struct<first: bigint, last: bigint, begin: bigint, q: bigint, slots: array<bigint>, share: double>>>>"
    small = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(per_source)), schema)).alias("s"))

    bucketed = rows.join(F.broadcast(small.select("s.k", "s.buckets")), "k").withColumns({"h": F.when(F.col("id").isNull(), whole).otherwise(F.xxhash64("id")), "g": whole}).withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("k", "bucket").agg(F.count("*").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("k", "bucket").orderBy("h", "id", "g")) - 1).join(sizes, ["k", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumns({"block": F.floor(F.col("rank") / block_rows), "seat": F.col("rank") % block_rows})
    placed = ranked.join(F.broadcast(small.select("s.k", "s.phases")), "k").withColumn("p", F.filter("phases", lambda p: F.col("block").between(p["first"], p["last"]))[0])
    j = F.col("block") - F.col("p.first")
    n = F.size("p.slots")
    slot = F.col("p.begin") + F.floor(j / n) * F.col("p.q") + F.element_at("p.slots", (j % n + 1).cast("int"))
    out = placed.select(*names, slot.alias("mix_slot"), F.col("seat").cast("long").alias("mix_seat"), F.col("block").alias("mix_block"), F.col("p.share").alias("mix_weight"))
    return out.toDF(*docs.columns, "mix_slot", "mix_seat", "mix_block", "mix_weight")
