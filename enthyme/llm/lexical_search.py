"""Ranked lexical search: three-phase uniform threshold (TPUT) over term-partitioned postings.

0. Every whole text is read once; what it holds of the items' terms is written by document. The lists are then dealt by term
   and sorted by impact, the part of a term's contribution that depends on the document; a list of over LIST_PART entries
   is dealt in parts. N, L and the lists' lengths come from all documents.
1. Heads. The K entries of highest impact of each list give partial scores; an item's K-th partial score is a lower bound t.
2. Uniform threshold. From every list of an item with m terms, all entries contributing at least t / m are fetched. They meet by
   document, where the items' partial scores are one sparse product for a block of documents. What a document lacks of an
   item's lists adds less than t / m for each, which gives an upper bound; the K-th partial score is a better lower bound, and
   documents whose upper bound is below it are out.
3. Exact scores. The entries below the threshold are looked up for the candidates that are left.

No bound drops a document that could be among the K: ties with the K-th stay candidates until ranks are given.

Items are a query set against all documents, in blocks of about MOST_PAIRS terms; a block's terms travel with its tasks.

Defined results: a null text has no terms; a document without terms isn't counted; rows that repeat a document's id are
documents of their own, ranked by id and then in any order, null ids last; rows that repeat an item's id, null ones included, are
one item with the terms of all. An item without terms or without documents has no rows; nor has an empty table. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, binaries, ceil_div, n_parts, saved, sliced

K = 50
#: (item, term) pairs of a block of items, about: some 10 MB with the strings.
MOST_PAIRS = 200_000
#: Entries of a list that are dealt together.
LIST_PART = 1_000_000
#: Partial scores that a task holds at once.
CELLS = 2_000_000
#: An impact is below 10**9 * tf / (1000 * tf), so it fits into these bits.
IMPACT_BITS = 20

#: What separates terms, as the bytes of UTF-8 and as a pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    terms = F.explode(F.split(ascii_lower(F.col(text_col)), SEPARATORS)).alias("term")
    return items.select(F.col(item_col).alias("item"), terms).filter("term <> ''").distinct()


def held_terms(vocabulary: dict[bytes, int]):
    """One row for each document with terms: a number of its own, its id, how many terms it has, and which of the vocabulary, how often."""
    names = ["row", "doc_id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        get = vocabulary.get
        for batch in sliced(batches, "text"):
            keep, rows, ns, ends, terms, tfs = [], [], [], [0], [], []
            for at, text in enumerate(binaries(batch.column(1))):
                words = text.translate(TERM_BYTES).split()
                if not words:
                    continue
                counts = Counter(map(get, words))
                counts.pop(None, None)
                keep.append(at)
                rows.append(row)
                ns.append(len(words))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
                row += 1
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), *lists], names)

    return run


def kth(scores: DataFrame, k: int) -> dict[int, int]:
    """The k-th highest score of each item that has one."""
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    return dict(scores.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k).select("item", "score").collect())


class Block:
    """The terms of a block of items, as arrays: pair p is of item item[p] and term term[p]; the pairs of a term stand together."""

    def __init__(self, pairs: list[tuple[int, int]], df: dict[int, int], documents: int) -> None:
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        # a term without documents, or without weight, adds nothing to any score
        self.pairs = sorted((t, i, weight[t]) for i, t in pairs if weight.get(t, 0) > 0)
        self.terms_of = Counter(i for _, i, _ in self.pairs)

    def table(self, spark, rows: list[tuple], schema: str) -> DataFrame:
        """A table with at most as many rows as the block has pairs."""
        return F.broadcast(spark.createDataFrame(rows, schema))

    def pair_table(self, spark, bound: dict[int, int]) -> DataFrame:
        """With `least`, the lowest impact that reaches an item's threshold in a term's list."""
        rows = [(t, i, w, ceil_div(bound.get(i, 0), w * self.terms_of[i])) for t, i, w in self.pairs]
        return self.table(spark, rows, "term int, item int, w long, least long")


def partial_scores(block: Block, bound: dict[int, int], k: int):
    """Documents (row, packed entries) to (item, row, score, found): what may be among an item's best, as far as a task can tell."""
    items = sorted(block.terms_of)
    place = {i: x for x, i in enumerate(items)}
    term, item, weight = (np.array(c, dtype=np.int64) for c in zip(*((t, place[i], w) for t, i, w in block.pairs), strict=True))
    count = np.array([block.terms_of[i] for i in items], dtype=np.int64)
    t1 = np.array([bound.get(i, 0) for i in items], dtype=np.int64)
    slack = np.maximum(t1 - 1, 0) // count  # the most that a list may add where nothing of it was fetched
    first = np.searchsorted(term, np.arange(term[-1] + 2))
    names = np.array(items, dtype=np.int32)
    chunk = max(1, CELLS // len(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, len(items)), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                lists = part.column(1)
                size, packed = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(size)), size)
                t, impact = packed >> IMPACT_BITS, packed & ((1 << IMPACT_BITS) - 1)
                wide = first[t + 1] - first[t]
                ends = np.cumsum(wide)
                pair = np.repeat(first[t] - (ends - wide), wide) + np.arange(ends[-1] if len(ends) else 0)
                gain, cell = weight[pair] * np.repeat(impact, wide), np.repeat(doc, wide) * len(items) + item[pair]
                fetched = gain * count[item[pair]] >= t1[item[pair]]
                # scores are whole numbers far below 2**53: sums of doubles are exact
                score = np.bincount(cell[fetched], gain[fetched], len(size) * len(items)).astype(np.int64).reshape(-1, len(items))
                found = np.bincount(cell[fetched], minlength=len(size) * len(items)).reshape(-1, len(items))
                seen = np.concatenate([best, score])
                best = np.partition(seen, len(seen) - k, axis=0)[-k:]
                keep = (score > 0) & (score + (count - found) * slack >= np.maximum(t1, best.min(axis=0)))
                d, i = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), part.column(0).take(pa.array(d)), pa.array(score[d, i]), pa.array(found[d, i].astype(np.int32))], ["item", "row", "score", "found"])

    return run


def impact(documents: int, words: int) -> Column:
    """From a document's tf and n: 64-bit integers, rounded down."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {documents}L) div {words}L))")


def ranked_block(docs: DataFrame, wanted: DataFrame, k: int, list_part: int) -> DataFrame | None:
    """(item, row, doc_id, score) of what ranks among the k of the items in `wanted` (item, term); null if no document has terms."""
    spark = docs.sparkSession
    pairs = wanted.collect()  # a block
    vocabulary = {t: x for x, t in enumerate(sorted({r.term for r in pairs}))}
    reads = docs.mapInArrow(held_terms({t.encode(): x for t, x in vocabulary.items()}), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")
    held = saved(reads, "terms")
    documents, words = held.agg(F.count("*"), F.sum("n")).first()
    df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most one row for each term of the block
    if not df:
        return None
    block = Block([(r.item, vocabulary[r.term]) for r in pairs], df, documents)
    if not block.pairs:
        return None

    parts = block.table(spark, [(t, ceil_div(n, list_part)) for t, n in df.items()], "term int, parts int")
    entries = held.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("row", "n", F.col("e.terms").alias("term"), F.col("e.tfs").cast("long").alias("tf"))
    entries = entries.join(parts, "term").select("term", F.pmod(F.xxhash64("row"), "parts").alias("part"), "row", impact(documents, words).alias("impact"))
    lists = saved(entries.repartition(n_parts(spark), "term", "part").sortWithinPartitions("term", F.desc("impact")).drop("part"), "lists")

    by_impact = Window.partitionBy("term").orderBy(F.desc("impact"))
    heads = lists.withColumn("r", F.row_number().over(by_impact)).filter(F.col("r") <= k)
    gain = (F.col("w") * F.col("impact")).alias("gain")
    t1 = kth(heads.join(block.pair_table(spark, {}), "term").select("item", "row", gain).groupBy("item", "row").agg(F.sum("gain").alias("score")), k)

    found = block.pair_table(spark, t1)
    reach = F.broadcast(found.groupBy("term").agg(F.min("least").alias("from"), F.max("least").alias("below")))
    packed = (F.shiftleft(F.col("term").cast("long"), IMPACT_BITS) + F.col("impact")).alias("e")
    fetched = lists.join(reach, "term").filter("impact >= from").select("row", packed).groupBy("row").agg(F.collect_list("e").alias("entries"))
    partial = saved(fetched.mapInArrow(partial_scores(block, t1, k), "item int, row long, score long, found int"), "partial")
    t2 = kth(partial, k)

    bounds = [(i, m, max(t1.get(i, 0) - 1, 0) // m, max(t1.get(i, 0), t2.get(i, 0))) for i, m in block.terms_of.items()]
    candidates = partial.join(block.table(spark, bounds, "item int, m int, slack long, least long"), "item").filter("score + (m - found) * slack >= least").select("item", "row", "score")
    candidates = saved(candidates, "candidates")
    rest = lists.join(reach, "term").filter("impact < below").drop("from", "below").join(found, "term").filter("impact < least")
    added = rest.select("item", "row", gain).join(candidates.select("item", "row"), ["item", "row"]).select("item", "row", F.col("gain").alias("score"))
    exact = candidates.unionByName(added).groupBy("item", "row").agg(F.sum("score").alias("score"))
    return exact.join(held.select("row", "doc_id"), "row")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, most_pairs: int = MOST_PAIRS, list_part: int = LIST_PART) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = saved(item_terms(items, item_col, item_text_col), "asked")
    blocks = ceil_div(asked.count(), most_pairs)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    out = [spark.createDataFrame([], f"item_id {asked.schema['item'].dataType.simpleString()}, rank int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")]
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        names = [r.item for r in mine.select("item").distinct().orderBy("item").collect()]  # at most a block's pairs
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"number int, item {asked.schema['item'].dataType.simpleString()}"))
        wanted = mine.join(numbers, mine["item"].eqNullSafe(numbers["item"])).select(F.col("number").alias("item"), "term")
        found = ranked_block(rows, wanted, k, list_part)
        if found is not None:
            best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            out.append(best.join(numbers.withColumnRenamed("item", "item_id"), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM postings JOIN sizes USING (doc_id) JOIN weights USING (term) JOIN asked USING (term), whole GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
