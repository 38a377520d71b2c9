"""Language identification with a string kernel.

A text is the set of its character n-grams of 2 to 4 characters (blended spectrum), hashed into BUCKETS bits. The kernel of
two texts is the number of shared bits over the root of the product of their own numbers. LANDMARKS training texts per
language span a Nyström approximation of that kernel; one-versus-rest kernel ridge regression on it gives a score for each
language. A batch of texts is scored by two matrix products.

The classifier is fitted on a bounded sample: PER_LANGUAGE labelled texts for each language, chosen by a hash of the id.
Only their bit sets (BUCKETS / 8 bytes each) reach the driver. Prediction reads whole texts, and nothing but texts.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing could be learned; ties go to
the language first in order. Rows with a null label or id train nothing. Repeated rows give repeated results; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced

BUCKETS = 1 << 15
PER_LANGUAGE, LANDMARKS, RIDGE = 160, 40, 1e-2
#: Differences of scores are multiplied by this before the softmax that gives the score of a prediction.
SHARPNESS = 8.0
FOLDS, HELD_OUT = 4, 2


class Spectrum:
    """Bit sets of hashed n-grams."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)

    def bits(self, text: str | None) -> np.ndarray | None:
        """One byte per bucket, or None for a text without letters."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = points < 0x10000
        letters = self.letter[np.where(low, points, 0)]
        if not low.all():
            letters |= ~low & np.fromiter((chr(c).isalpha() for c in points), dtype=bool, count=len(points))
        if not letters.any():
            return None
        points = np.where(letters, points, np.uint32(32))
        points = np.concatenate([[32], points[~((points == 32) & (np.concatenate([[32], points[:-1]]) == 32))], [32]]).astype(np.uint32)
        out = np.zeros(BUCKETS, dtype=np.uint8)
        h = points
        for n in range(2, 5):
            if len(points) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
            out[((h * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)] = 1
        return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_bits(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Bit sets and languages of the sample. The ids are chosen without reading a text."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull())
    sample = texts.join(F.broadcast(chosen), "id").select("id", "lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in sliced(batches, "text"):
            rows = [(i, lang, np.packbits(b).tobytes()) for i, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (b := spectrum.bits(t)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["id", "lang", "bits"])

    rows = sorted((r.lang, r.id, bytes(r.bits)) for r in sample.mapInArrow(pack, "id long, lang string, bits binary").collect())
    seen: dict[str, int] = {}
    rows = [r for r in rows if seen.setdefault(r[0], 0) < per_language and not seen.update({r[0]: seen[r[0]] + 1})]  # repeated ids
    x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), BUCKETS // 8)
    return x, [r[0] for r in rows]


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x, y: 0/1 rows as float32."""
    return (x @ y.T) / np.sqrt(np.outer(np.maximum(x.sum(axis=1), 1), np.maximum(y.sum(axis=1), 1)))


class Model:
    """Landmarks, and the weights that turn kernel values with them into scores."""

    def __init__(self, packed: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(languages))
        if not self.languages:
            return
        y = np.array([[1.0 if x == k else -1.0 for k in self.languages] for x in languages])
        x = np.unpackbits(packed, axis=1).astype(np.float32)
        rows = [i for k in self.languages for i in [j for j, z in enumerate(languages) if z == k][:landmarks]]
        self.packed = packed[rows]
        values, vectors = np.linalg.eigh(kernel(x[rows], x[rows]).astype(np.float64))
        keep = values > 1e-6 * values.max()
        to_features = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel(x, x[rows]).astype(np.float64) @ to_features
        counts = np.array([languages.count(z) for z in languages], dtype=np.float64)
        weight = (1 / counts)[:, None] * len(languages) / len(self.languages)  # languages weigh alike
        self.offset = (weight * y).sum(axis=0) / weight.sum()
        inner = features.T @ (weight * features) + ridge * len(languages) * np.eye(features.shape[1])
        self.weights = (to_features @ np.linalg.solve(inner, features.T @ (weight * (y - self.offset)))).astype(np.float32)

    def scores(self, x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        return kernel(x, landmarks) @ self.weights + self.offset


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; `und` where no language was found."""
    model = Model(*training_bits(docs, id_col, text_col, lang_col, per_language))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def predictor(model: Model, texts_at: int = 2, batch_rows: int = 128):
    """For mapInArrow: replaces the text column, the last, by the prediction and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        landmarks = np.unpackbits(model.packed, axis=1).astype(np.float32) if model.languages else None
        for batch in sliced(batches, "text"):
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                found = [spectrum.bits(t) if landmarks is not None else None for t in part.column(texts_at).to_pylist()]
                names, scores = ["und"] * len(found), [0.0] * len(found)
                if some := [i for i, b in enumerate(found) if b is not None]:
                    raw = SHARPNESS * model.scores(np.stack([found[i] for i in some]).astype(np.float32), landmarks)
                    best = raw.argmax(axis=1)
                    share = 1 / np.exp(raw - raw.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, k, s in zip(some, best, share, strict=True):
                        names[i], scores[i] = model.languages[k], float(s)
                yield pa.RecordBatch.from_arrays([*part.columns[:texts_at], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:texts_at], "lang_pred", "score"])

    return run


def in_some_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose text is in one of the learned languages, with all their columns; only `und` goes."""
    model = Model(*training_bits(docs, id_col, text_col, lang_col, per_language))
    at = len(docs.columns)
    names = [f"c{i}" for i in range(at)]
    predict = predictor(model, at)
    rows = docs.withColumn("__text", F.col(text_col)).toDF(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in predict(batches):
            known = pa.compute.not_equal(batch.column(at), "und")
            yield pa.RecordBatch.from_arrays([c.filter(known) for c in batch.columns[:at]], names)

    return rows.mapInArrow(run, rows.drop("text").schema).toDF(*docs.columns)
