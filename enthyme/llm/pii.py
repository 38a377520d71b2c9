"""Personal data by patterns, and terms that reveal it by information theory.

Patterns find the protected entities: e-mail addresses, IP addresses, card numbers that pass Luhn, telephone numbers. A text is then a
sequence of terms and mentions of entities, read through every sliding window of WINDOW of them, windows that hang over its ends included.
Over the windows of all texts, copies too, the windows that hold a term t, an entity e and both give them a pointwise mutual
information; divided by the information content of e it says what share of e's information t discloses. A term that stands with an
entity in at least SUPPORT neighbourhoods that differ (copies of a text are no new evidence), with a share of DISCLOSURE or more, discloses it; it is
a span of kind `term` at every place of every text, whether the entity is named there or not. `sanitised` generalises entities to their kind
and removes the terms.

Three passes: windows that hold mentions; windows that hold each candidate term; spans. Terms are 64-bit hashes. The lists of
terms that go to the executors hold at most MOST_TERMS and pass through the driver one by one; with more candidates all terms are
counted, with more disclosing terms the last pass is made once for each part of the list.

Defined results: a null text is empty and has no spans; matches that fail their test are dropped without another try; terms
that overlap an entity are none; repeated rows give repeated results; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, saved, sliced

KINDS = ("email", "ip", "card", "phone")
#: Terms and mentions in a window, neighbourhoods that a term needs, share of the entity's information.
WINDOW, SUPPORT, DISCLOSURE = 21, 3, 0.8
#: Hashes in a list that is sent to executors (16 MB), and counts that a task gathers before it hands them on.
MOST_TERMS, GATHERED = 2_000_000, 200_000

# The patterns of the contract, written so that no text makes them backtrack: runs are possessive, and a run of digits is
# entered at its first digit only, where a match would begin anyway.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1) if start == at else max(floor, at)
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) by start, then kind as listed."""
    out = [(s, e, 0, text[s:e].lower()) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1, m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2, digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), m.end(), 3, digits))
    return [(s, e, KINDS[k], v) for s, e, k, v in sorted(out, key=lambda x: (x[0], x[2]))]


def terms_of(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms that overlap no span."""
    ends: list[int] = []  # the furthest end of the spans so far
    for _, e, _, _ in spans:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _, _, _ in spans]
    out = []
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end())  # the spans that begin before the term ends
        if not k or ends[k - 1] <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def signed(value: str) -> int:
    h = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


class Hashes(dict):
    """Raw term to the hash of its lower-cased form, 0 for one that isn't wanted. Forgets everything at GATHERED entries."""

    def __init__(self, wanted: np.ndarray | None) -> None:
        self.wanted = wanted  # sorted

    def __missing__(self, term: str) -> int:
        if len(self) >= GATHERED:
            self.clear()
        h = signed(term.lower())
        if self.wanted is not None:
            k = int(np.searchsorted(self.wanted, h))
            h = h if k < len(self.wanted) and self.wanted[k] == h else 0
        self[term] = h
        return h


def sequence(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, str, str]]:
    """(start, term, "") and (start, value, kind) in the order of the text."""
    return sorted([(s, t, "") for t, s, _ in terms_of(text, spans)] + [(s, value, kind) for s, _, kind, value in spans])


def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, context, windows, terms, both) of every entity of a text: a hash of its neighbourhoods, how many windows hold it, and the
    terms in them, with how many of those windows hold each."""
    reach = WINDOW - 1
    for batch in sliced(batches, "text"):
        out = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            if not spans:
                continue
            tokens = sequence(text, spans)
            named: dict[str, list[int]] = {}
            for k, (_, value, kind) in enumerate(tokens):
                if kind:
                    named.setdefault(f"{kind}:{value}", []).append(k)
            for entity, places in named.items():
                # a window goes by its last place: those with place k end at k to k + reach
                low = places[0] - reach
                held = np.zeros(places[-1] + 2 * reach + 2 - low, dtype=np.int64)
                for k in places:
                    held[k - low : k - low + WINDOW] = 1
                before = np.concatenate([[0], np.cumsum(held)])
                both: Counter[str] = Counter()
                last: dict[str, int] = {}
                near, done = [], max(0, low)
                for place in places:
                    for k in range(max(done, place - reach), min(len(tokens), place + WINDOW)):
                        _, value, kind = tokens[k]
                        near.append(f"{k - low}:{kind}:{value}")
                        if not kind:
                            both[value] += int(before[k - low + WINDOW] - before[max(k, last.get(value, k - WINDOW) + WINDOW) - low])
                            last[value] = k
                    done = max(done, place + WINDOW)
                if both:
                    out.append((signed(entity), signed(" ".join(near)), int(before[-1]), [signed(t) for t in both], list(both.values())))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["entity", "context", "windows", "terms", "both"])


def windows_with(wanted: np.ndarray | None):
    """(term, n): how many windows hold each wanted term (None: each term), as partial counts; under the term 0
    the number of windows. wanted is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(wanted)
        counts: Counter[int] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in sliced(batches, "text"):
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                if spans:
                    tokens = [0 if kind else hashes[t] for _, t, kind in sequence(text, spans)]
                else:
                    tokens = [hashes[t] for t in TERM.findall(text or "")]
                if not tokens:
                    continue
                counts[0] += len(tokens) + WINDOW - 1
                last: dict[int, int] = {}
                for k, h in enumerate(tokens):
                    if h:
                        counts[h] += min(WINDOW, k - last.get(h, k - WINDOW))
                        last[h] = k
                if len(counts) >= GATHERED:
                    yield hand_on()
        if counts:
            yield hand_on()

    return run


def sorted_terms(terms: DataFrame) -> np.ndarray:
    """At most about MOST_TERMS."""
    return np.sort(terms.toArrow().column("term").to_numpy())


def disclosing(texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term), saved: the terms that disclose at least that share of some entity's information. texts has one column, text."""
    found = texts.mapInArrow(mentions, "entity long, context long, windows long, terms array<long>, both array<long>")
    contexts = found.groupBy("entity", "context").agg(F.count("*").alias("copies"), F.first("windows").alias("windows"), F.first(F.arrays_zip("terms", "both")).alias("terms"))
    contexts = saved(contexts, "contexts")
    entities = contexts.groupBy("entity").agg(F.sum(F.col("copies") * F.col("windows")).alias("n_e"))
    held = contexts.select("entity", "copies", F.explode("terms").alias("t")).groupBy("entity", F.col("t.terms").alias("term"))
    pairs = held.agg(F.sum(F.col("copies") * F.col("t.both")).alias("n_te"), F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    pairs = saved(pairs.join(entities, "entity"), "pairs")
    candidates = saved(pairs.select("term").distinct(), "candidates")
    n = candidates.count()
    if not n:
        return candidates
    wanted = sorted_terms(candidates) if n <= MOST_TERMS else None
    counts = saved(texts.mapInArrow(windows_with(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t")), "counts")
    total = float(counts.filter("term = 0").first().n_t)
    pmi = F.log(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    information = F.log(F.lit(total) / F.col("n_e"))
    known = pairs.join(counts, "term").filter((information > 0) & (pmi >= disclosure * information))
    return saved(known.select("term").distinct(), "disclosing")


def parts_of(terms: DataFrame) -> Iterator[np.ndarray]:
    """The terms as sorted lists of at most about MOST_TERMS, one after the other."""
    n = ceil_div(terms.count(), MOST_TERMS)
    for i in range(n):
        yield sorted_terms(terms.filter(F.pmod("term", F.lit(n)) == i))


def term_spans(text: str, spans: list[tuple[int, int, str, str]], hashes: Hashes) -> list[tuple[int, int, str, str]]:
    return [(s, e, "term", t) for t, s, e in terms_of(text, spans) if hashes[t]]


def in_order(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    return sorted(spans, key=lambda x: (x[0], (*KINDS, "term").index(x[2]), x[1]))


def marked(rows: DataFrame, parts: Iterator[np.ndarray]) -> DataFrame:
    """Rows (..., text) with the column `terms`: start and end of each place of a disclosing term."""
    rows = rows.withColumn("terms", F.array().cast("array<int>"))
    schema = rows.schema

    def mark(part: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes(part)
            for batch in sliced(batches, "__text"):
                out = []
                for text, before in zip(batch.column("__text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                    found = []
                    if any(map(hashes.__getitem__, TERM.findall(text or ""))):  # most texts have none; only the others are read term by term
                        found = [x for s, e, _, _ in term_spans(text, base_spans(text), hashes) for x in (s, e)]
                    out.append((before or []) + found)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int32()))], schema.names)

        return run

    before = None
    for part in parts:
        if before is not None:
            rows = saved(rows.mapInArrow(mark(before), schema), "marked")
        before = part
    return rows if before is None else rows.mapInArrow(mark(before), schema)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    parts = parts_of(disclosing(docs.select(F.col(text_col).alias("text")), support, disclosure))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            out = []
            for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = base_spans(text or "")
                every = in_order(base + [(s, e, "term", "") for s, e in zip(terms[::2], terms[1::2], strict=True)])
                named = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, e, kind, _ in spans)
                out.append((*(sum(kind == k for _, _, kind, _ in base) for k in KINDS), hashlib.sha256(named(base).encode()).hexdigest(), named(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return marked(rows, parts).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with entities replaced by their kind and disclosing terms removed; where spans overlap, the first goes. A null text
    stays null, repeated rows stay, and other columns are carried along."""
    schema, at = docs.schema, docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(schema))]
    rows = docs.toDF(*names).withColumn("__text", F.col(names[at]))
    parts = parts_of(disclosing(docs.select(F.col(text_col).alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            texts = []
            for text, terms in zip(batch.column("__text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                out, done = [], 0
                for s, e, kind, _ in in_order(base_spans(text or "") + [(s, e, "term", "") for s, e in zip(terms[::2], terms[1::2], strict=True)]):
                    if s >= done:
                        out += [text[done:s], "" if kind == "term" else f"[{kind.upper()}]"]
                        done = e
                texts.append(None if text is None else "".join(out) + text[done:])
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return marked(rows, parts).mapInArrow(run, schema)
