"""Licence scan by a positional rare-token index.

Templates are word sequences: four short phrases and passages of well-known licences. A first pass over all texts counts in
how many documents each template word occurs; that gives every word an IDF. The index maps each template's rarest words to
(template, position). A second pass looks up the words of each text, intersects the postings by relative position (a
template that starts at word s has its word p at s + p) and verifies:

* a phrase needs its rarest word at the right place and then all its words, so every place is found;
* a passage needs at least half of its rarest words to agree on one start, one of its mandatory key phrases nearby, and
  SIMILAR of its words in place or shifted by a few words.

Defined results: a null text is empty and has no labels; ties between starts go to the smaller; repeated rows give repeated
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, sliced

#: The phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Name, label, mandatory key phrases (one must occur), and a passage of the licence's public text.
PASSAGES = (
    ("mit-grant", "mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd-terms", "bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-grant", "isc", ("permission to use copy modify and or distribute",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-header", "apache", ("you may not use this file except in compliance",), "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-header", "gpl", ("redistribute it and or modify it under the terms of the gnu general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-header", "lgpl", ("gnu lesser general public license",), "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-header", "agpl", ("gnu affero general public license",), "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-header", "mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "cc-by-sa", ("creative commons attribution sharealike",), "licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "cc-by-nc", ("creative commons attribution noncommercial",), "licensed under a creative commons attribution noncommercial international license"),
    ("cc-by-long", "cc-by", ("creative commons attribution",), "licensed under a creative commons attribution international license"),
    ("epl", "epl", ("eclipse public license",), "made available under the terms of the eclipse public license"),
)
#: Rarest words of a passage that are indexed, the share of a passage's words that must be found, and by how many words
#: they may have moved.
RARE, SIMILAR, SHIFT = 8, 0.8, 4

#: Bytes that are not of a word become spaces, A-Z become a-z; the bytes of characters beyond ASCII stay.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Index:
    """Rarest words to (template, position). idf: of every word of a template."""

    def __init__(self, phrases, passages, idf: dict[bytes, float]) -> None:
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.passages = [(text.encode().split(), [k.encode().split() for k in keys], label) for _, label, keys, text in passages]
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for k, (words, _) in enumerate(self.phrases):
            rarest = max(range(len(words)), key=lambda i: (idf[words[i]], -i))
            self.anchors.setdefault(words[rarest], []).append((k, rarest))
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for k, (words, _, _) in enumerate(self.passages):
            chosen = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:RARE]
            self.needed.append((len(chosen) + 1) // 2)
            for i in chosen:
                self.postings.setdefault(words[i], []).append((k, i))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """The starts of phrases, their labels, the passages' labels, and the best share of words found."""
        starts: list[int] = []
        base: set[str] = set()
        own: set[str] = set()
        votes: Counter = Counter()
        known = self.anchors.keys() | self.postings.keys()
        if known.isdisjoint(words):
            return starts, base, own, 0.0
        for at, word in enumerate(words):
            if word not in known:
                continue
            for k, i in self.anchors.get(word, ()):
                phrase, label = self.phrases[k]
                if at >= i and words[at - i : at - i + len(phrase)] == phrase:
                    starts.append(at - i)
                    base.add(label)
            for k, i in self.postings.get(word, ()):
                votes[k, at - i] += 1
        best = 1.0 if starts else 0.0
        # starts that lie within SHIFT words of each other vote together
        for (k, start), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            together = sum(votes.get((k, start + d), 0) for d in range(-SHIFT, SHIFT + 1))
            if together < self.needed[k]:
                continue
            passage, keys, label = self.passages[k]
            near = words[max(0, start - SHIFT) : max(0, start + len(passage) + SHIFT)]
            if not any(near[j : j + len(key)] == key for key in keys for j in range(len(near) - len(key) + 1)):
                continue
            offset = start - max(0, start - SHIFT)
            found = sum(w in near[max(0, i + offset - SHIFT) : i + offset + SHIFT + 1] for i, w in enumerate(passage)) / len(passage)
            if found >= SIMILAR:
                own.add(label)
                best = max(best, found)
        return starts, base, own, best


def word_idf(docs: DataFrame, text_col: str, phrases=PHRASES, passages=PASSAGES) -> dict[bytes, float]:
    """IDF of each word of a template over all texts; only the counts of those few words reach the driver."""
    vocabulary = sorted({w for p, _ in phrases for w in p.encode().split()} | {w for p in passages for w in p[3].encode().split()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, rows = set(vocabulary), Counter(), 0
        for batch in sliced(batches, "text"):
            for text in binaries(batch.column(0)):
                seen.update(known.intersection(words_of(text)))
                rows += 1
        found = {**seen, b"": rows}
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r.word.encode(): r.n for r in counted.collect()}
    total = df.get(b"", 0)
    return {w: log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    idf = word_idf(docs, text_col, phrases, passages)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(phrases, passages, idf)
        for batch in sliced(batches, "text"):
            out = []
            for text in binaries(batch.column(1)):
                words = words_of(text)
                starts, base, own, score = index.scan(words)
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], NAMES)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
