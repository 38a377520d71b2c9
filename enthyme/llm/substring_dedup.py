"""Substring deduplication with repeated-phrase automata.

A window is WINDOW consecutive words. The words of a window that also starts in a document with a smaller id are removed.

1. Phrases. Of each window the eight-word run with the smallest hash is its phrase; equal windows have equal phrases at
   equal places, and neighbours mostly share theirs, so a text has about one phrase per 20 words. Phrases that occur in
   two documents recur.
2. Automata. Documents are dealt into buckets by id. Each bucket gets the recurring phrases of its own documents, compiles
   them with pyahocorasick (a word is four characters there), and streams its documents through that automaton, which
   locates every occurrence. Only windows around an occurrence that is their phrase are candidates. Every text thus meets one automaton,
   whose size follows the bucket's, however large the corpus.
3. Confirmation. Candidates are compared by 64-bit window hashes within their phrase, first with the phrase's first
   document, then, for what differs from that, by the smallest id with the same window. So a passage that a third of all
   documents share costs one comparison for each occurrence.
4. Removal. The confirmed windows go to their documents; texts that cannot have any are not shuffled.

Defined results: a null text has no words; texts shorter than a window lose nothing; a row with a null id is neither
searched nor a source; rows that repeat an id are no earlier than each other. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, binaries, ceil_div, member_filter, passes, saved, sliced

WINDOW, PHRASE = 50, 8
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 8_000_000


#: Characters that stand for a word in an automaton.
CHARACTERS = 4
#: Windows that are searched together: their places fit into 16 bits.
BLOCK = 1 << 15


def leftmost_min(values: np.ndarray, wide: int) -> np.ndarray:
    """Where the smallest of each `wide` consecutive values is, the leftmost if equal. The low 16 bits of the values are 0 and take
    the places, so that minima of twice the width come from two of the last."""
    low = values | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64(0xFFFF)).astype(np.int64)


class Reader:
    """Words, phrases and windows of a text."""

    def __init__(self, window: int = WINDOW, phrase: int = PHRASE) -> None:
        self.window, self.phrase = window, phrase
        self.hashes, self.rolling = WordHashes(), Rolling()

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and for each window the place of its phrase."""
        h = self.hashes.of(text.split())
        if len(h) < self.window:
            return h, np.empty(0, dtype=np.int64)
        runs = self.rolling.runs(h, self.phrase) & ~np.uint64(0xFFFF)
        wide = self.window - self.phrase + 1
        places = [start + leftmost_min(runs[start : start + BLOCK + wide - 1], wide) for start in range(0, len(runs) - wide + 1, BLOCK)]
        return h, np.concatenate(places)

    @staticmethod
    def symbols(h: np.ndarray) -> str:
        """CHARACTERS of 64 kinds per word: the automaton looks through the letters that follow a state one by one, so there are few."""
        places = np.array([58, 52, 46, 40], dtype=np.uint64)
        return (((h[:, None] >> places) & np.uint64(63)).astype(np.uint8) + np.uint8(48)).tobytes().decode("ascii")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and kept_text, its kept words joined by a space."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = ceil_div(size, bucket_bytes) or 1
    known = docs.filter("id IS NOT NULL AND text IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))

    phrases = saved(known.select("id", "bucket", "text").mapInArrow(name_phrases(window), "phrase string, id long, bucket long"), "phrases")
    recurring = saved(phrases.groupBy("phrase").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("phrase", "first"), "recurring")
    shards = phrases.select("phrase", "bucket").join(recurring, "phrase").distinct()
    found = known.groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInArrow(locate(window), "phrase long, id long, leads boolean, start long, offset long, windows array<long>")
    found = saved(found, "occurrences")

    leaders = found.filter("leads").groupBy("phrase").agg(F.min_by(F.struct("offset", "windows"), "start").alias("l")).select("phrase", "l.offset", "l.windows")
    compared = found.join(leaders.select("phrase", F.col("offset").alias("l_offset"), F.col("windows").alias("l_windows")), "phrase")
    compared = compared.select("phrase", "id", "leads", "start", "offset", "windows", "l_offset", "l_windows")
    compared = saved(compared.mapInArrow(compare, "phrase long, id long, start long, n long, window long"), "compared")
    open_windows = compared.filter("window IS NOT NULL")
    firsts = open_windows.groupBy("phrase", "window").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("phrase", "window", "first")
    later = open_windows.join(firsts, ["phrase", "window"]).filter("id > first").select("id", "start", "n")
    runs = saved(compared.filter("window IS NULL").select("id", "start", "n").unionByName(later).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")

    some = docs.select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(settle(member_filter(runs, "id")), "id long, n_words long, kept_sha256 string, kept_text string, text string")
    every = some.join(runs, "id", "left").select("id", "n_words", "kept_sha256", "kept_text", "text", "runs")
    return every.mapInArrow(remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def name_phrases(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(window)
        for batch in sliced(batches, "text"):
            out: list[tuple[str, int, int]] = []
            for i, bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), strict=True):
                h, at = reader.read(text)
                if len(at):
                    s = reader.symbols(h)
                    out += [(x, i, bucket) for x in {s[CHARACTERS * p : CHARACTERS * (p + reader.phrase)] for p in np.unique(at).tolist()}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["phrase", "id", "bucket"])

    return run


def locate(window: int):
    """For each bucket: candidates in its documents, one row for each place of a recurring phrase and the windows whose phrase it is."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = ["phrase", "id", "leads", "start", "offset", "windows"]

    def run(documents: pa.Table, shard: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        automaton = ahocorasick.Automaton()
        firsts = shard.column("first").to_numpy()
        for k, phrase in enumerate(shard.column("phrase").to_pylist()):
            automaton.add_word(phrase, k)
        reader = Reader(window)
        if len(automaton) and documents.num_rows:
            automaton.make_automaton()
            for i, text in zip(documents.column("id").to_pylist(), binaries(documents.column("text")), strict=True):
                h, at = reader.read(text)
                if not len(at):
                    continue
                hits = np.array([(end, k) for end, k in automaton.iter(reader.symbols(h))], dtype=np.int64).reshape(-1, 2)
                if not len(hits):
                    continue
                hits = hits[hits[:, 0] % CHARACTERS == CHARACTERS - 1]  # the others begin inside a word
                which = np.full(len(h), -1, dtype=np.int64)
                which[hits[:, 0] // CHARACTERS - reader.phrase + 1] = hits[:, 1]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                lengths = np.diff(np.concatenate([begins, [len(at)]]))
                here = which[at[begins]] >= 0
                if not here.any():
                    continue
                begins, size, places = begins[here], lengths[here], at[begins[here]]
                values = reader.rolling.runs(h, reader.window).view(np.int64)[np.repeat(here, lengths)]
                keys = reader.rolling.runs(h, reader.phrase).view(np.int64)[places]
                parts.append((keys, np.full(len(keys), i, dtype=np.int64), firsts[which[places]] == i, begins, places - begins, size, values))
        if not parts:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        *flat, size, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))
        return pa.Table.from_arrays([*(pa.array(c) for c in flat), lists], names)

    return run


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows equal to the leader's at the same place beside the phrase, as runs (window null); others one by one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        phrase, i, leads, start, offset = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        mine, theirs, l_offset = batch.column(5), batch.column(7), batch.column(6).to_numpy(zero_copy_only=False)
        size, l_size = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (mine, theirs))
        values, l_values = mine.flatten().to_numpy(), theirs.flatten().to_numpy()
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), size)
        j = np.arange(len(values)) - np.repeat(ends - size, size)  # place in the row
        there = j + (l_offset - offset)[row]
        inside = (there >= 0) & (there < l_size[row])
        equal = np.zeros(len(values), dtype=bool)
        equal[inside] = values[inside] == l_values[(np.cumsum(l_size) - l_size)[row[inside]] + there[inside]]
        # runs of equal windows within a row, except in the leader itself
        gone = equal & ~leads.astype(bool)[row]
        before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
        opens, shuts = np.flatnonzero(gone & (~before | (j == 0))), np.flatnonzero(gone & (~after | (j == size[row] - 1)))
        for at, n, window in ((opens, shuts - opens + 1, None), (o := np.flatnonzero(~equal), np.ones(len(o), dtype=np.int64), values[o])):
            r = row[at]
            named = pa.nulls(len(at), pa.int64()) if window is None else pa.array(window, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(phrase[r], pa.int64()), pa.array(i[r], pa.int64()), pa.array(start[r] + j[at], pa.int64()), pa.array(n, pa.int64()), named], ["phrase", "id", "start", "n", "window"])


def settle(filter_words: np.ndarray):
    """Documents that lose nothing are finished here; the others keep their text for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            maybe = passes(filter_words, batch.column(1).to_numpy())
            raw = binaries(batch.column(2))
            words = [t.split() for t in raw]
            kept = [None if m else b" ".join(w) for m, w in zip(maybe, words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([None if k is None else hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([t if m else None for m, t in zip(maybe, raw, strict=True)], pa.binary()).cast(pa.string())],
                ["id", "n_words", "kept_sha256", "kept_text", "text"],
            )

    return run


def remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, counts, digests, texts, raw, runs = (c.to_pylist() for c in batch.columns)
            for n, digest, kept, text, mine in zip(counts, digests, texts, raw, runs, strict=True):
                if digest is None:
                    words = text.encode().split()
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in mine or ():
                        cover[r["start"]] += 1
                        cover[r["start"] + r["n"] + window - 1] -= 1
                    stay = np.cumsum(cover)[:-1] == 0
                    joined = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
                    out.append((n, n - int(stay.sum()), hashlib.sha256(joined).hexdigest(), joined.decode()))
                else:
                    out.append((n, 0, digest, kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run
