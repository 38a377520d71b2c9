"""Benchmark decontamination by SimHash over item-sized windows; DataFrame and SQL functions only.

A benchmark item of L words is compared with windows of L words of the documents. Fingerprinted are the windows that can be the best one:
a shingle at word i of a document and word j of the item lies on the diagonal i - j. A window that begins before all diagonals
of the shingles it shares, or after them, shares no more than the one that begins at the nearest of them. If it begins between
two that are g apart, g words are inserted or left out, so g + 4 of the L - 4 shingles or more are not shared; similarity 0.8
leaves a ninth. So windows begin on a diagonal or up to (L - 4) / 9 - 4 words after one (`FOLLOWING`). Fingerprints are
64-bit SimHashes of a window's words. They are looked up in a multi-index: six blocks of the fingerprint, of which one
differs in at most two bits if the whole differs in at most RADIUS = 17, so every item within the radius is found. Each
candidate is then verified: Jaccard similarity of the shingles weighted by how often they occur, 0.8 or more.

Words are runs of letters and digits, lower-cased. Items of fewer than five words are compared by shingles of their own
length. Defined results: null or wordless texts and items are never contaminated; a document shorter than an item is one
window; ties between windows go to the first; rows that repeat an id are one document, contaminated if any of them is; a
null id is reported as null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sized

SHINGLE, RADIUS = 5, 17
#: Offsets and widths of the blocks of a fingerprint, and how many bits of a block may differ.
BLOCKS, FLIPS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)), RADIUS // 6
#: SQL: how many starts after a diagonal may be the best window's, for an item of n words.
FOLLOWING = "greatest(0, (n - 4) DIV 9 - 4)"
NOT_WORD = r"[^\\p{L}\\p{N}]+"
#: Benchmarks of up to this many shingles are broadcast (about 60 bytes each); larger ones are shuffled.
BROADCAST_SHINGLES = 500_000

HASHES = f"transform(filter(split(lower(coalesce(t, '')), '{NOT_WORD}'), w -> w <> ''), w -> xxhash64(w))"


def shingles(k: int) -> str:
    """SQL for the hashes of all runs of k of the array `hashes`."""
    run = ", ".join(f"hashes[i + {j}]" if j else "hashes[i]" for j in range(k))
    return f"if(size(hashes) < {k}, array(), transform(sequence(0, greatest(size(hashes) - {k}, 0)), i -> xxhash64({run}, {k})))"


def numbered(column: str) -> str:
    """SQL that makes each occurrence of a repeated value of a short array its own value, so that sets count repeats."""
    return f"transform({column}, (x, i) -> xxhash64(x, size(filter(slice({column}, 1, i + 1), y -> y = x))))"


#: SQL for the SimHash of the array `hashes`: each bit is the majority of that bit over the words.
SIMHASH = "aggregate(sequence(0, 63), 0L, (f, b) -> f | if(aggregate(hashes, 0, (n, h) -> n + if((shiftright(h, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L))"


def by_length(sizes: list[int]) -> str:
    """SQL for the shingles of an item or window: of SHINGLE words, or all words of a shorter one."""
    cases = "".join(f" WHEN k = {k} THEN {shingles(k)}" for k in sizes)
    return f"CASE{cases} END"


def block_values(fingerprint: str) -> str:
    return ", ".join(f"struct({i} AS block, shiftrightunsigned({fingerprint}, {at}) & {(1 << width) - 1}L AS value)" for i, (at, width) in enumerate(BLOCKS))


def probes(fingerprint: str) -> str:
    """SQL for all block values within FLIPS bits of the fingerprint's."""
    parts = []
    for i, (at, width) in enumerate(BLOCKS):
        masks = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(width), n)]
        parts.append(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> struct({i} AS block, (shiftrightunsigned({fingerprint}, {at}) & {(1 << width) - 1}L) ^ m AS value))")
    return f"concat({', '.join(parts)})"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words) of every document and item that meet: the best window's similarity, its first word
    and its length."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).selectExpr("item_id", HASHES + " AS hashes")
    items = items.withColumn("n", F.size("hashes")).filter("n > 0").withColumn("k", F.least("n", F.lit(SHINGLE)))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())
    if not sizes:
        sizes = [SHINGLE]
    items = saved(items.selectExpr("*", f"{by_length(sizes)} AS runs", f"{SIMHASH} AS print"), "items")
    index = saved(items.select("item_id", "n", "k", F.posexplode("runs").alias("at", "run")), "index")
    index_rows = index.count()
    small = F.broadcast if index_rows <= BROADCAST_SHINGLES else lambda x: x

    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).selectExpr("id", HASHES + " AS hashes")
    runs = words.selectExpr("id", "size(hashes) AS size", "concat(" + ", ".join(shingles(k) for k in sizes) + ") AS runs", f"array({', '.join(f'greatest(size(hashes) - {k - 1}, 0)' for k in sizes)}) AS parts")
    seeds = runs.select("id", "size", "parts", F.posexplode_outer("runs").alias("i", "run")).join(small(index.select("item_id", "n", "k", "at", "run")), "run")
    # (outer: else the optimiser tests size(runs) below and works out `hashes` again for every run)
    # runs of several lengths stand one after another: the start of a run counts from the first of its length
    start = "i"
    for j, k in reversed(list(enumerate(sizes))):
        base = " + ".join(f"parts[{x}]" for x in range(j)) or "0"
        start = f"CASE WHEN k = {k} THEN i - ({base}) ELSE {start} END"
    seeds = seeds.selectExpr("id", "n", "k", "size", f"{start} - at AS diagonal").distinct()
    seeds = seeds.selectExpr("id", "n", "k", "size", f"explode(sequence(diagonal, diagonal + {FOLLOWING})) AS start")
    seeds = saved(seeds.selectExpr("id", "n", "k", "greatest(0, least(start, size - n)) AS start").distinct(), "seeds")

    # a text is hashed once, and only if it has a seed
    seeded = saved(seeds.select(F.col("id").alias("seed_id")).distinct(), "seeded")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(sized(seeded), F.expr("id <=> seed_id"), "left_semi")
    windows = texts.selectExpr("id", HASHES + " AS hashes").join(sized(seeds.withColumnRenamed("id", "seed_id")), F.expr("id <=> seed_id"))
    windows = windows.selectExpr("id", "n", "k", "start", "slice(hashes, start + 1, n) AS hashes").filter("size(hashes) > 0")
    windows = windows.selectExpr("id", "n", "k", "start", f"{by_length(sizes)} AS runs", f"{SIMHASH} AS print")
    windows = windows.selectExpr("id", "n", "start", f"{numbered('runs')} AS runs", "print")
    targets = saved(items.selectExpr("item_id", "n", "print AS item_print", f"explode({probes('print')}) AS p").select("item_id", "n", "item_print", "p.*").distinct(), "targets")
    sets = items.selectExpr("item_id AS set_id", "n AS set_n", "print AS set_print", f"{numbered('runs')} AS item_runs")
    looked_up = windows.selectExpr("*", f"explode(array({block_values('print')})) AS p").select("id", "n", "start", "runs", "print", "p.*")
    pairs = looked_up.join(sized(targets), ["block", "value", "n"])
    pairs = pairs.filter(F.expr(f"bit_count(print ^ item_print) <= {RADIUS}")).dropDuplicates(["id", "start", "n", "item_id", "print", "item_print"])
    pairs = pairs.join(small(sets), F.expr("item_id <=> set_id AND n = set_n AND item_print = set_print"))
    scored = pairs.selectExpr("id", "item_id", "start", "n", "size(array_intersect(runs, item_runs)) AS both", "size(array_union(runs, item_runs)) AS either")
    found = scored.filter("5 * both >= 4 * either").withColumn("similarity", F.col("both") / F.col("either"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("b")
    return found.groupBy("id", "item_id").agg(best).selectExpr("id AS doc_id", "item_id", "-b.s AS similarity", "CAST(b.start AS bigint) AS start", "CAST(b.n AS bigint) AS n_words")


SQL = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents
), b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark
), bs AS (
  SELECT item_id, len(w) AS n, i AS at, list_slice(w, i, i + 4) AS run FROM b, unnest(range(1, len(w) - 3)) AS r(i)
), ds AS (
  SELECT doc_id, len(w) AS size, i AS at, list_slice(w, i, i + 4) AS run FROM w, unnest(range(1, len(w) - 3)) AS r(i)
), seeds AS (
  SELECT DISTINCT doc_id, n, greatest(0, least(ds.at - bs.at + g, size - n)) AS start FROM ds JOIN bs USING (run), unnest(range(0, greatest(0, (n - 4) // 9 - 4) + 1)) AS f(g)
), windows AS (
  SELECT doc_id, n, start, list_slice(w, start + 1, start + n) AS w FROM seeds JOIN w USING (doc_id)
), wr AS (
  SELECT doc_id, n, start, list_slice(w, i, i + 4) AS run, count(*) AS c FROM windows, unnest(range(1, len(w) - 3)) AS r(i) GROUP BY ALL
), br AS (SELECT item_id, n, run, count(*) AS c FROM bs GROUP BY ALL),
wt AS (SELECT doc_id, n, start, sum(c) AS total FROM wr GROUP BY ALL), bt AS (SELECT item_id, sum(c) AS total FROM br GROUP BY ALL),
shared AS (
  SELECT doc_id, item_id, wr.n, start, sum(least(wr.c, br.c)) AS c FROM wr JOIN br ON wr.run = br.run AND wr.n = br.n GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, n, start, c::DOUBLE / (wt.total + bt.total - c) AS similarity
  FROM shared JOIN wt USING (doc_id, n, start) JOIN bt USING (item_id) WHERE 5 * c >= 4 * (wt.total + bt.total - c)
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start, arg_min(n, (-similarity, start))::BIGINT AS n_words
FROM scored GROUP BY doc_id, item_id
"""
