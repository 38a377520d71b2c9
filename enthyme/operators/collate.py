"""Alignment of witnesses of one text, and a vote where they differ.

Two token lists are aligned from coarse to fine: runs of sixteen tokens that each has once and only once fix a frame, the
longest that rises in both; between its points runs of eight do so, then of four, of two, of one; what is left between two points
is matched by sequence comparison, however long it is. Then blocks that one witness has elsewhere are matched by the same runs,
without order, among the tokens that are still free. Pairs are independent rows, so witnesses of many texts go in one call.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens in a run, from coarse to fine; a block that was moved has at least MOVED tokens.
GRAINS, MOVED = (16, 8, 4, 2, 1), 12


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both numbers; pairs come by rising first number. A Fenwick tree over the ranks of the
    second numbers holds the longest chain that ends below each. Of equally long chains the one that ends lowest is taken."""
    rank = {y: r for r, y in enumerate(sorted({y for _, y in pairs}), 1)}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(rank) + 1)  # length, last pair
    length, before = [0] * len(pairs), [-1] * len(pairs)
    top = (0, -1)
    for i, (_, y) in enumerate(pairs):
        best, r = (0, -1), rank[y] - 1
        while r:
            best = max(best, tree[r], key=lambda x: x[0])
            r &= r - 1
        length[i], before[i] = best[0] + 1, best[1]
        r = rank[y]
        while r < len(tree):
            if tree[r][0] < length[i]:
                tree[r] = (length[i], i)
            r += r & -r
        if top[1] < 0 or (length[i], -y) > (top[0], -pairs[top[1]][1]):
            top = (length[i], i)
    chain, i = [], top[1]
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def single(tokens: list[str], places: range | list[int], n: int) -> dict[tuple, int]:
    """Runs of n tokens that stand at exactly one of the places."""
    where: dict[tuple, int] = {}
    for i in places:
        run = tuple(tokens[i : i + n])
        where[run] = -1 if run in where else i
    return {run: i for run, i in where.items() if i >= 0}


def aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal tokens, by rising place in x. They rise in y too, but for blocks that stand elsewhere there."""
    at: dict[int, int] = {}
    stretches = [(0, len(x), 0, len(y))]
    for n in GRAINS:
        finer = []
        for a, b, c, d in stretches:
            here, there = single(x, range(a, b - n + 1), n), single(y, range(c, d - n + 1), n)
            i, j = a, c
            for s, t in rising(sorted((s, there[run]) for run, s in here.items() if run in there)):
                for k in range(n):
                    if s + k >= i and t + k >= j:
                        finer.append((i, s + k, j, t + k))
                        at[s + k] = t + k
                        i, j = s + k + 1, t + k + 1
            finer.append((i, b, j, d))
        stretches = [z for z in finer if z[0] < z[1] and z[2] < z[3]]
    for a, b, c, d in stretches:
        for m in SequenceMatcher(None, x[a:b], y[c:d], autojunk=False).get_matching_blocks():
            at.update((a + m.a + k, c + m.b + k) for k in range(m.size))
    return sorted((at | moved(x, y, at)).items())


def moved(x: list[str], y: list[str], at: dict[int, int]) -> dict[int, int]:
    """Blocks of free tokens that stand elsewhere in the other witness."""
    used = set(at.values())
    free = lambda n, taken: [i for i, run in enumerate(lengths(n, taken)) if run >= MOVED]
    here, there = single(x, free(len(x), at), MOVED), single(y, free(len(y), used), MOVED)
    out: dict[int, int] = {}
    for run, i in here.items():
        if run in there:
            for k in range(MOVED):
                if i + k not in out and there[run] + k not in used:
                    out[i + k] = there[run] + k
                    used.add(there[run] + k)
    return out


def lengths(n: int, taken) -> list[int]:
    """For each place, how many free places begin there."""
    out = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        out[i] = 0 if i in taken else out[i + 1] + 1
    return out[:n]


def agreement(pairs: DataFrame) -> DataFrame:
    """(a, b, tokens_a, tokens_b, equal, rate) of pairs (a, b, text_a, text_b): rate is the share of the longer text's tokens that the other has
    in the same order, or in a block that was moved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, s, t in zip(f["a"], f["b"], f["text_a"], f["text_b"], strict=True):
                x, y = (s or "").split(), (t or "").split()
                n = len(aligned(x, y))
                out.append((a, b, len(x), len(y), n, n / max(len(x), len(y), 1)))
            yield pd.DataFrame(out, columns=["a", "b", "tokens_a", "tokens_b", "equal", "rate"])

    k = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(run, f"a {k}, b {k}, tokens_a int, tokens_b int, equal int, rate double")


def vote(readings: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(place, reading, by) of readings (place, witness, reading): the majority; without one, the only reading that is a known word; without
    one, null, by `dispute`. Ties in the majority are none."""
    counted = readings.groupBy("place", "reading").agg(F.count("*").alias("n"))
    known = counted.join(lexicon.select(F.col("word").alias("reading")).distinct().withColumn("known", F.lit(True)), "reading", "left")
    each = known.groupBy("place").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reading"))).alias("r"), F.collect_list(F.when(F.col("known"), F.col("reading"))).alias("words"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    won = second.isNull() | (first["n"] < second["n"])
    one_word = F.size("words") == 1
    return each.select("place", F.when(won, first["reading"]).when(one_word, F.col("words")[0]).alias("reading"), F.when(won, "majority").when(one_word, "lexicon").otherwise("dispute").alias("by"))
