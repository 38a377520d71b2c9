"""Fill-in-middle transformation by one numpy kernel per batch, on Arrow's UTF-8 buffers.

All texts of a batch are one array of bytes. A look-up table gives each byte's class, a mask over adjacent bytes gives the
ends of units, a cumulative sum that is reset at each document counts them, and one `searchsorted` finds the cuts of all rows.
Characters are counted the same way, from the bytes that begin one. The pieces of all outputs are gathered at once.

A unit is a run of other characters with the white space before it, or white space at the end of a text. The choices of a row
come from the sha256 of SEED, a colon and its id, so they don't depend on partitions, order or retries.

Defined results: a null text is empty; a null id counts as an empty one; rows that repeat an id are cut by the same numbers; an
empty text, or one that holds a marker, stays plain. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

SEED = "42"
#: Per cent of texts that are transformed, and of those the ones with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Prefix, suffix and middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
FORMS = np.array(["plain", "psm", "spm"])

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
    return data, at - at[0]


def running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def with_marker(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a marker."""
    held = np.zeros(len(at) - 1, dtype=bool)
    for marker in MARKERS:
        here = np.ones(max(0, len(data) - len(marker) + 1), dtype=bool)
        for k, byte in enumerate(marker):
            here &= data[k : k + len(here)] == byte
        begins = np.flatnonzero(here)
        row = np.searchsorted(at, begins, side="right") - 1
        held[row[begins + len(marker) <= at[row + 1]]] = True
    return held


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the places in data where its prefix and its middle end."""
    space = SPACE[data]
    ends = np.zeros(len(data), dtype=bool)
    ends[:-1] = ~space[:-1] & space[1:]
    filled = at[1:] > at[:-1]
    ends[at[1:][filled] - 1] = True
    units = running(ends)
    n = units[at[1:]] - units[at[:-1]]
    a, b = h1 % (n + 1), h2 % (n + 1)
    found = [np.searchsorted(units, units[at[:-1]] + k) for k in (np.minimum(a, b), np.maximum(a, b))]
    return n, np.maximum(found[0], at[:-1]), np.maximum(found[1], at[:-1])  # no unit: where the text begins


def gathered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """One text per row of (rows, pieces) bounds, its pieces put together."""
    size = (stops - starts).ravel()
    ends = np.cumsum(size)
    out = data[np.repeat(starts.ravel() - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    at = np.concatenate([[0], ends[starts.shape[1] - 1 :: starts.shape[1]]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(out)])


def transform(rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, at = buffers(batch.column(1))
            h = [c.to_numpy() for c in batch.columns[2:6]]
            n, first, second = cuts(data, at, h[0], h[1])
            changed = (at[1:] > at[:-1]) & ~with_marker(data, at) & (h[2] % 100 < rate)
            form = np.where(changed, np.where(h[3] % 100 < suffix_first, 2, 1), 0)
            characters = running((data & 0xC0) != 0x80)
            # markers stand behind the texts; a plain text is one piece and five empty ones
            source = np.concatenate([data, np.frombuffer(b"".join(MARKERS), dtype=np.uint8)])
            p, s, m = (len(data) + np.full(len(n), 3 * k) for k in range(3))
            prefix, middle, suffix = (at[:-1], first), (first, second), (second, at[1:])
            tag = lambda x: (x, x + 3)
            orders = {1: (tag(p), prefix, tag(s), suffix, tag(m), middle), 2: (tag(s), suffix, tag(p), prefix, tag(m), middle)}
            bounds = np.zeros((2, len(n), 6), dtype=np.int64)
            bounds[:, :, 0] = at[:-1], at[1:]
            for which, pieces in orders.items():
                rows = form == which
                for k, piece in enumerate(pieces):
                    for side in range(2):
                        bounds[side, rows, k] = piece[side][rows]
            lengths = [pa.array(characters[stop] - characters[start], pa.int64(), mask=~changed) for start, stop in (prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()), *lengths, gathered(source, *bounds).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *numbers)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(transform(rate, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. It holds no marker, and no two markers overlap, so the first one found is the one put in."""
    p, s, m = (F.lit(x.decode()) for x in MARKERS)
    second = F.when(form == "psm", F.locate("<S>", output, 4)).otherwise(F.locate("<P>", output, 4))
    third = F.locate("<M>", output, 4)
    one, two, middle = output.substr(F.lit(4), second - 4), output.substr(second + 3, third - second - 3), output.substr(third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(docs: DataFrame, **options) -> DataFrame:
    """The rows of fill_in_middle with the sha256 of the output and of the text rebuilt from it, in place of the output."""
    made = fill_in_middle(docs, **options)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS d FROM documents
), t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM h
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
