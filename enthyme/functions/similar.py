"""Near matches of a quotation, where it is not in a text word for word.

Runs of RUN characters that both share vote for the place at which the quotation would begin; votes for places near each other are one
candidate, if they are VOTES of the quotation's runs or more. Every text is read once against all quotations of a block, so no
candidate is lost before the votes are counted. A candidate whose longest common subsequence is too short for the ratio is out;
the others are scored by sequence comparison, those with the most votes first, down to half of the most.

What may be lost: a match with an edit in nearly every RUN characters, or whose edits spread its votes over places further apart than an eighth of
its length. Tests measure the share of matches of LEAST or more that is found, by kind and rate of edits and by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import folded

# Fixed value: the least ratio of a near match.
LEAST = 0.75
#: Characters in a run that votes, and the share of the runs that must vote for a place.
RUN, VOTES = 6, 0.06
#: Characters after which a comparison is given up if too many were passed over.
CHECKED = 16
#: Characters of quotations that are looked for together, about: their runs travel with the tasks.
BLOCK_CHARS = 500_000


def runs(text: str) -> np.ndarray:
    """One number for each run of RUN characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < RUN:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(points) - RUN + 1, dtype=np.uint64)
    for k in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - RUN + 1 + k]
    return out ^ (out >> np.uint64(32))


def places_of(a: str) -> dict[str, int]:
    """The places of each character, a bit for each."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def common(a: str, b: str, masks: dict[str, int] | None = None, need: float = 0) -> int:
    """The length of the longest common subsequence, a bit for each character of a; -1 as soon as it is sure to be under the need."""
    masks = places_of(a) if masks is None else masks
    full = (1 << len(a)) - 1
    row, spare = full, len(b) - need
    for at in range(0, len(b), CHECKED):
        part = b[at : at + CHECKED]
        for c in part:
            if hit := row & masks.get(c, 0):
                row = ((row + hit) | (row - hit)) & full
        if at + len(part) - len(a) + row.bit_count() > spare:  # characters of b passed over
            return -1
    return len(a) - row.bit_count()


class Quotations:
    """The runs of a block of quotations, sorted, with the quotation and the place of each."""

    BITS = 20

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        each = [runs(t) for t in texts]
        self.size = np.array([len(r) for r in each], dtype=np.int64)
        self.wide = np.maximum(8, np.array([len(t) for t in texts], dtype=np.int64) // 8)  # edits shift what follows them by a few characters
        every = np.concatenate(each) if each else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.runs = every[order]
        self.which = np.repeat(np.arange(len(texts)), self.size)[order]
        self.place = np.concatenate([np.arange(n) for n in self.size])[order] if each else order
        self.masks: dict[int, dict[str, int]] = {}
        self.known = np.zeros(1 << self.BITS, dtype=bool)
        self.known[self.runs & np.uint64((1 << self.BITS) - 1)] = True

    def begins(self, text: str) -> list[tuple[int, list[tuple[int, int]]]]:
        """(quotation, (votes, place) with the most votes first) of those that may begin in the text."""
        there = runs(text)
        at = np.flatnonzero(self.known[there & np.uint64((1 << self.BITS) - 1)])
        lo, hi = (np.searchsorted(self.runs, there[at], side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(at, n)
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(at))
        q = self.which[entry]
        enough = np.maximum(2, np.ceil(VOTES * self.size)).astype(np.int64)
        keep = (np.bincount(q, minlength=len(self.texts)) >= enough)[q]
        q, place = q[keep], (at - self.place[entry])[keep]
        if not len(q):
            return []
        # a place's cell rises with it, so one sort of both in one number brings cells together
        low = int(place.min())
        many = int(place.max()) - low + 1
        both = np.sort(q * many + (place - low))
        q, place = both // many, both % many + low
        cell = np.floor_divide(place, self.wide[q]) + 9  # a quotation may begin before the text
        many = int(cell.max()) + 2
        key = q * many + cell
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        votes = np.diff(np.append(opens, len(key)))
        cells = key[opens]
        beside = np.zeros(len(cells), dtype=np.int64)
        follows = np.flatnonzero(cells[1:] == cells[:-1] + 1)
        beside[follows] = votes[follows + 1]
        whose = cells // many
        found: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(votes + beside >= enough[whose]).tolist():
            # the place that most of the cell votes for
            values, counts = np.unique(place[opens[k] : opens[k] + votes[k]], return_counts=True)
            found.setdefault(int(whose[k]), []).append((int(votes[k] + beside[k]), max(0, int(values[counts.argmax()]))))
        return [(w, sorted(c, key=lambda x: (-x[0], x[1]))) for w, c in sorted(found.items())]

    def near(self, text: str) -> Iterator[tuple[int, float, int]]:
        """(quotation, best ratio of a stretch of the text as long as it, where that starts)."""
        matcher = SequenceMatcher(None, autojunk=False)
        for w, found in self.begins(text):
            quote = self.texts[w]
            at = text.find(quote)
            if at >= 0:
                yield w, 1.0, at
                continue
            best, place = 0.0, -1
            for votes, start in found:
                if 2 * votes < found[0][0]:
                    break
                there = text[start : start + len(quote)]
                if w not in self.masks:
                    self.masks[w] = places_of(quote)
                need = max(best, LEAST) * (len(quote) + len(there)) / 2
                if common(quote, there, self.masks[w], need) < need:  # what sequence comparison finds is a common subsequence
                    continue
                matcher.set_seq2(quote)  # nothing is done again where it is the same
                matcher.set_seq1(there)
                ratio = matcher.ratio()
                if ratio > best or ratio == best and start < place:
                    best, place = ratio, start
            if place >= 0:
                yield w, best, place


def nearest(quote: str, text: str) -> tuple[float, int]:
    """The best ratio of a stretch of the text as long as the quotation, and where it starts (0 and -1 without a place)."""
    return next(((ratio, at) for _, ratio, at in Quotations([quote]).near(text)), (0.0, -1))


def near_quotations(quotes: DataFrame, sources: DataFrame, q: str = "item_id", s: str = "doc_id", text: str = "text", least: float = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(quote_id, source_id, ratio, at) of quotations and sources, folded, that hold a stretch so like them; 1 where they hold the quotation itself. Null and
    empty quotations are not looked for."""
    asked = quotes.select(F.col(q).alias("quote_id"), folded(F.col(text)).alias("quote")).filter("quote <> ''")
    size = asked.agg(F.sum(F.length("quote"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    body = sources.select(F.col(s).alias("source_id"), folded(F.col(text)).alias("body"))
    kind, source = (df.schema[0].dataType.simpleString() for df in (asked, body))
    out = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(blocks)) == b).toArrow()  # a block

        def run(batches: Iterator[pa.RecordBatch], mine: pa.Table = mine) -> Iterator[pa.RecordBatch]:
            block = Quotations(mine.column("quote").to_pylist())
            ids = mine.column("quote_id").combine_chunks()
            for batch in batches:
                rows = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) for x in block.near(t) if x[1] >= least]
                at, which, ratio, place = ([r[k] for r in rows] for k in range(4))
                columns = [ids.take(pa.array(which, pa.int64())), batch.column(0).take(pa.array(at, pa.int64())), pa.array(ratio, pa.float64()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["quote_id", "source_id", "ratio", "at"])

        out.append(body.mapInArrow(run, f"quote_id {kind}, source_id {source}, ratio double, at int"))
    return reduce(DataFrame.unionByName, out)
