"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct n-word shingles, each a 64-bit hash. Under any order of all tokens, two sets of similarity
t or more share a token among the first p = |s| - ceil(t |s|) + 1 of each; among the first p + e they share e + 1. The filters of
three orders are intersected before any text is moved:

* order A is the hash itself. It cuts each set to its first p + e tokens, with e = p / 2;
* order B puts rare tokens first, by how many sets have them among those (counted over all documents). Similar sets share
  k of the p + e tokens, so they share one of the first p + e - k + 1 under order B. k is e + 1, and that place p, unless a
  smaller partner's own p + e tokens are fewer (`second_prefix`). Tokens of one set only, most of all, come first there and
  can meet nobody, so sets that merely share a common passage are out. What is left are posting lists, each of sets of a size
  class and the next one: the sizes of similar sets differ by less than two classes;
* order C is another hash. It cuts each set to p + e tokens too. Of the members of a family of posting lists (below), those stay
  of whose cut k tokens are in cuts of other members, under order C and then under order A (`crossed`).

Groups of copies are not expanded into pairs. Equal sets are one node. In each posting list every node is compared with
one pivot b only; the lists of one pivot are its family. For two members x and y that is still exact, because of this: write dx, dy
for their differences from b. If x and y are similar but not both similar to b, then dx and dy must share at least
(wx + wy - (1 - t) |b|) / (1 + t) tokens, where w = |b - x| + t |x - b|. So what remains is an overlap join of the small
differences under the same pivot, again by a hash cut and rare tokens first, and their overlap gives the similarity without
the texts. Members that are both similar to b are in one component already. Where the lists of differences would still give more pairs than
they have rows, they get pivots of their own, round by round: members that a pivot joins to the most frequent component of a
list need no further partner in it. The pairs that are left are all compared. Components are found by star contraction.

Defined results: a null text, or one without words, has the empty set, and is linked with nothing; a text of fewer words
than a shingle is one shingle of all its words; a document with a null id has a null component; rows that repeat an id are
one document, linked if any of its texts is. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, binaries, ceil_div, discard, member_filter, mixed, passes, saved, sized, sliced, without
from .components import smallest_reachable

#: Similarity as a fraction, and words in a shingle.
SIMILARITY, WORDS = (9, 10), 3
#: Tokens beyond the needed ones in a cut of differences; members of a family that are compared in one run of rows.
SPARE, TOGETHER = 64, 1000


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text. Sorting them is order A."""

    def __init__(self, k: int) -> None:
        self.k, self.words, self.rolling = k, WordHashes(), Rolling()

    def of(self, text: bytes) -> np.ndarray:
        words = self.words.of(text.lower().split())
        return np.unique(self.rolling.runs(words, min(self.k, len(words)))) if len(words) else words


#: Order C: tokens by this hash of theirs, which stands for them.
ORDER_C = np.uint64(xxhash.xxh3_64_intdigest("order C"))


def third_prefix(tokens: np.ndarray, size: int) -> np.ndarray:
    keys = mixed(tokens ^ ORDER_C)
    return np.partition(keys, size - 1)[:size] if size < len(keys) else keys


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_size(n: int, p: int, q: int) -> int:
    return n - ceil_div(p * n, q) + 1


def first_prefix(n: int, p: int, q: int) -> int:
    """p + e tokens under order A."""
    return min(n, 3 * prefix_size(n, p, q) // 2)


@lru_cache(100_000)
def second_prefix(n: int, p: int, q: int) -> int:
    """Places under order B that hold a shared token with a similar set of any size m. The k-th token that two sets share comes
    under order A at place n - o + k or before in one and m - o + k in the other, where o is the least overlap; so the first
    tokens share the k that fit into both, and the foremost of these under order B has k - 1 of them behind it."""
    m = np.arange(ceil_div(p * n, q), q * n // p + 1, dtype=np.int64)
    own, other = first_prefix(n, p, q), np.minimum(m, 3 * (m + -p * m // q + 1) // 2)
    o = -(-p * (n + m) // (p + q))
    return int((own - np.minimum(own - n + o, other - m + o) + 1).max())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = saved(docs.mapInArrow(described(words, *similarity), "id long, n long, signature binary, prefix array<long>, place int, third array<long>").withColumn("node", F.monotonically_increasing_id()), "sets")
    found = saved(sets.select("id", "n", "signature", "node"), "documents")
    own = found.filter("n > 0 AND id IS NOT NULL")
    classes = saved(own.groupBy("signature").agg(F.min(F.struct("id", "node")).alias("x")).select("signature", "x.id", "x.node"), "classes")
    copies = saved(own.select("node", "signature").join(classes.select("signature", F.col("node").alias("first")), "signature").filter("node <> first").select("node"), "copies")
    distinct = without(sets.filter("n > 0 AND id IS NOT NULL"), "node", copies)
    live = rare_first(distinct, *similarity)
    pairs = crossed(pivots(live), distinct)
    discard(live, sets, copies)
    links = linked(docs, pairs, classes, words, similarity)
    near = links.filter("linked").select("a", "b").unionByName(around(links, *similarity))
    names = classes.select("node", "id")
    edges = near.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select("x", "y")
    # rows that repeat an id join the classes of their texts
    alike = own.select("id", "signature").join(classes.select("signature", F.col("id").alias("first")), "signature").filter("id <> first").select("id", "first")
    found_in = saved(smallest_reachable(edges.union(alike)), "components")
    every = found.select("id", "n").join(found_in, found["id"] == found_in["node"], "left")
    return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def described(words: int, p: int, q: int):
    """Of each text: the size and signature of its set, its cut under order A, places under order B, and its cut under order C."""
    none = np.empty(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in sliced(batches, "text"):
            out = []
            for text in binaries(batch.column(1)):
                s = shingler.of(text)
                n = len(s)
                first, third = (s[: first_prefix(n, p, q)].view(np.int64), third_prefix(s, first_prefix(n, p, q)).view(np.int64)) if n else (none, none)
                out.append((n, signature(s), first, second_prefix(n, p, q) if n else 0, third))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["id", "n", "signature", "prefix", "place", "third"])

    return run


def rare_first(sets: DataFrame, p: int, q: int) -> DataFrame:
    """(node, list), saved: posting lists of sets (node, n, place, prefix), by the first places under the order that puts rare tokens first,
    as far as two nodes of like size have them. Tokens that one node has alone are counted, not carried."""
    # size and place travel as one number
    postings = sets.select("node", (F.shiftleft(F.size("prefix").cast("long"), 32) + F.col("place")).alias("shape"), F.explode("prefix").alias("token"))
    shared = saved(postings.select("token").groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    met = saved(postings.join(shared, "token"), "met")
    row = Window.partitionBy("node").orderBy("df", "token")
    alone = F.shiftright("shape", 32) - F.count("*").over(Window.partitionBy("node"))
    kept = met.withColumn("at", alone + F.row_number().over(row)).filter("at <= shape & 4294967295L").select("node", "token")
    # classes are a hair wider than similar sizes are apart, so that rounding cannot part them
    size_class = F.floor(F.log(F.col("n")) / (log(q / p) * (1 + 1e-9)))
    kept = kept.join(sets.select("node", size_class.alias("c")), "node")
    kept = saved(kept.select("node", F.explode(F.array(F.xxhash64("token", "c"), F.xxhash64("token", F.col("c") + 1))).alias("list")), "kept")
    again = kept.groupBy("list").agg(F.count("*").alias("df")).filter("df > 1").select("list")
    live = saved(kept.join(again, "list").select("node", "list"), "live")
    discard(shared, met, kept)
    return live


def pivots(live: DataFrame) -> DataFrame:
    """(a, b): every member of a posting list with the list's pivot, the member with the most live tokens. Any set may be the pivot
    of a list, so a pivot that is itself under one with more members hands its lists to that one: a family of copies gets
    one pivot, which is compared with each copy once."""
    weight = live.groupBy("node").agg(F.count("*").alias("w"))
    best = live.join(weight, "node").groupBy("list").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("x")).select("list", (-F.col("x.m")).alias("b"))
    members = saved(live.select("list", F.col("node").alias("a")).join(best, "list").select("a", "b").distinct(), "members")
    sizes = members.groupBy("b").agg(F.count("*").alias("n"))
    above = members.join(sizes, "b").join(sizes.select(F.col("b").alias("a")), "a", "left_semi")
    up = saved(above.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"))).alias("x")).select(F.col("a").alias("b"), (-F.col("x.m")).alias("up")), "up")
    top = up.join(up.select(F.col("b").alias("up"), F.col("up").alias("top")), "up").select("b", "top")
    return members.join(top, "b").select("a", F.col("top").alias("b")).filter("a <> b").distinct()


def crossed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), saved, whose member shares enough tokens of its cut under order C with other members of its family, pivot
    included, and then so under order A: a set that is similar to one of them shares k of them with it alone."""
    pairs = saved(pairs, "pairs")
    for order in ("third", "prefix"):
        family = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), "b").distinct()), "family")
        cuts = sets.select(F.col("node").alias("a"), (F.size("prefix") + 1 - F.col("place")).alias("k"), F.col(order).alias("cut"))
        tokens = saved(cuts.join(sized(family), "a").select("a", "b", "k", F.explode("cut").alias("token")), order)
        shared = tokens.groupBy("b", "token").agg(F.count("*").alias("df")).filter("df > 1").select("b", "token")
        kept = tokens.join(shared, ["b", "token"], "left_semi").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("k").alias("k"))
        kept = saved(kept.filter("n >= k").select("a", "b"), "crossed")
        discard(pairs, family, tokens)
        pairs = kept
    return pairs


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Of each pair, saved: whether it is similar, the size of a, its difference from b, whether it seeks partners in the family (it is not similar
    to b) or can be found by those that do, how many places of its difference it needs for that, and the cut under the hash."""
    p, q = similarity
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("runs"))
    # a family is compared in runs of about TOGETHER members; each run has its pivot first
    members = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), "runs").cast("int").alias("run"), F.lit(1).alias("kind"))
    roles = members.unionByName(sizes.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind")))
    roles = saved(roles.join(classes.withColumnRenamed("node", "a"), "a"), "roles")
    bits = member_filter(roles.select("id").distinct(), "id")

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passes(bits, batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["id", "text"])

    texts = docs.filter("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(maybe, "id long, text string")
    rows = saved(texts.join(roles, "id").select("b", "run", "kind", "a", "signature", "text"), "rows")
    rows = rows.repartition("b", "run").sortWithinPartitions("b", "run", "kind", "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        y, done = np.empty(0, dtype=np.uint64), None
        for batch in sliced(batches, "text", 1_000_000):
            out = []
            for b, kind, a, sign, text in zip(*(batch.column(k).to_pylist() for k in ("b", "kind", "a", "signature")), binaries(batch.column(5)), strict=True):
                if (b, kind, a) == done:
                    continue
                x = shingler.of(text)
                if signature(x) != sign:  # another text under this id
                    continue
                done = (b, kind, a)
                if kind == 0:
                    y = x
                    continue
                inside = np.isin(x, y, assume_unique=True)
                both = int(inside.sum())
                similar = q * both >= p * (len(x) + len(y) - both)
                added, missing = x[~inside], y[~np.isin(y, x, assume_unique=True)]
                w = q * len(missing) + p * len(added)  # q times the weight of the difference
                size = len(missing) + len(added)
                least = max(1, ceil_div(w + max(0, w - (q - p) * q * len(x) // p - 1) - (q - p) * len(y), q + p))
                far = 1 if similar else least
                narrow = max(0, size - max(far, w // (q + p) + 1) + 1)
                wide = 0 if similar else max(0, size - least + 1)
                places = max(narrow, wide)
                delta = np.concatenate([added, missing]) if places else added[:0]
                out.append((a, b, similar, len(x), delta.view(np.int64), wide > 0, narrow > 0, places, delta[: places + SPARE].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "linked", "n", "delta", "seeks", "found", "places", "cut"])

    links = saved(rows.mapInArrow(verify, "a long, b long, linked boolean, n long, delta array<long>, seeks boolean, found boolean, places int, cut array<long>"), "links")
    discard(roles)
    return links


def around(links: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): similar pairs of members of one family that are not both similar to its pivot. Differences that overlap as they must share a
    token of their first `places` under the family's own order, which puts rare tokens first, within a cut that puts tokens
    before others that the pivot has and then goes by the hash: the cuts hold SPARE + 1 shared tokens or all that are needed,
    as in orders A and B. (What strangers to the pivot share is mostly that they lack its tokens.)"""
    rows = links.filter("places > 0").join(links.filter("seeks").select("b").distinct(), "b", "left_semi")
    postings = rows.select("a", "b", "seeks", "found", "linked", "places", "n", F.size("delta").alias("d"), F.size("cut").alias("size"), F.explode("cut").alias("token"))
    counts = postings.groupBy("b", "token").agg(F.count("*").alias("df")).filter("df > 1")
    row = Window.partitionBy("a", "b").orderBy("df", "token")
    alone = F.col("size") - F.count("*").over(Window.partitionBy("a", "b"))
    placed = postings.join(counts, ["b", "token"]).withColumn("at", alone + F.row_number().over(row)).filter("at <= places")
    lists = saved(placed.select("a", "b", "token", "seeks", "found", "n", "d", (F.col("size") - F.col("at") + 1).alias("behind"), F.when(F.col("linked"), F.col("b")).otherwise(F.col("a")).alias("label")), "lists")
    pairs, before, turn = None, None, 0
    while True:
        heads = saved(headed(lists, turn), "heads")
        state = heads.agg(F.sum("cross").alias("cross"), F.sum("rows").alias("rows")).first()
        cross = state.cross or 0
        if cross <= max(state.rows or 0, FEW) or before is not None and cross > 0.8 * before:
            break
        before, turn = cross, turn + 1
        met = saved(alike(with_heads(lists, heads), links, p, q), "met")
        pairs = met if pairs is None else pairs.unionByName(met)
        better = met.filter("top").groupBy("b", "a").agg(F.min("label").alias("to"))
        lists, old = saved(lists.join(better, ["b", "a"], "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "lists"), lists
        discard(old, heads)
    x = lists.filter("seeks")
    y = lists.filter("found").select("b", "token", *(F.col(c).alias(f"{c}_y") for c in ("a", "label", "seeks", "n", "d", "behind")))
    # two members that seek each other meet once; the first token that they share has all others of the overlap behind it in both cuts
    once = (F.col("a") < F.col("a_y")) | ~F.col("seeks_y") | ~F.col("found")
    overlap = F.least(((p + q) * (F.col("d") + F.col("d_y")) - (q - p) * (F.col("n") + F.col("n_y"))) / (2 * (p + q)), F.lit(SPARE + 1))
    rest = x.join(y, ["b", "token"]).filter((F.col("label") != F.col("label_y")) & (F.col("a") != F.col("a_y")) & once & (F.least("behind", "behind_y") >= overlap)).select("a", "b", F.col("a_y").alias("y")).distinct()
    rest = saved(alike(rest.withColumns({"label": F.lit(0).cast("long"), "top": F.lit(False)}), links, p, q), "nearer")
    discard(lists, heads)
    pairs = rest if pairs is None else pairs.unionByName(rest)
    return pairs.select("a", F.col("y").alias("b"))


#: Lists of differences that give no more pairs than this are compared as they are.
FEW = 20_000


def headed(lists: DataFrame, turn: int) -> DataFrame:
    """Of each list: how many pairs of different labels it gives, its rows, the most frequent label among those that can be found, with one
    of its members (at first the one whose difference is smallest, later others), and the same of the smallest and the
    largest label."""
    count = lambda name: F.sum(F.col(name).cast("long"))
    first = F.xxhash64("a", F.lit(turn)) if turn else F.col("d").cast("long")
    member = F.min(F.when(F.col("found"), F.struct(first.alias("first"), "a")))["a"].alias("c")
    labels = lists.groupBy("b", "token", "label").agg(count("seeks").alias("s"), count("found").alias("f"), F.count("*").alias("n"), member)
    of = lambda *order: F.struct(*order, "label", "c")
    there = F.col("c").isNotNull()
    top, lo, hi = F.max(F.when(there, of("f"))).alias("top"), F.min(F.when(there, of())).alias("lo"), F.max(F.when(there, of())).alias("hi")
    return labels.groupBy("b", "token").agg((F.sum("s") * F.sum("f") - F.sum(F.col("s") * F.col("f"))).alias("cross"), F.sum("n").alias("rows"), top, lo, hi)


def with_heads(lists: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, y, label, top): members that seek, with the head of another label of each of their lists; its label, and whether that is the
    most frequent one."""
    rows = lists.filter("seeks").select("a", "b", "token", F.col("label").alias("own")).join(heads.filter("cross > 0").select("b", "token", "top", "lo", "hi"), ["b", "token"])
    other = lambda k: F.col("own") != F.col(f"{k}.label")
    pick = lambda field: F.when(other("top"), F.col(f"top.{field}")).when(other("hi"), F.col(f"hi.{field}")).when(other("lo"), F.col(f"lo.{field}"))
    return rows.select("a", "b", pick("c").alias("y"), pick("label").alias("label"), other("top").alias("top")).filter("y IS NOT NULL").groupBy("a", "b", "y").agg(F.min("label").alias("label"), F.max("top").alias("top"))


def alike(pairs: DataFrame, links: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs (a, y) of members of b that are similar. A token in both differences is in both sets or in neither, so the sets
    differ in the tokens of one difference only. The cuts of similar sets share as many tokens as they must; only for pairs
    that do the whole differences meet."""
    # similar: (q + p) * apart <= (q - p) * (n + n_y), where apart = d + d_y - 2 * overlap
    overlap = ((p + q) * (F.col("d") + F.col("d_y")) - (q - p) * (F.col("n") + F.col("n_y"))) / (2 * (p + q))
    cuts = links.select("b", "a", "n", F.size("delta").alias("d"), "cut")
    rows = pairs.join(cuts, ["b", "a"]).join(cuts.toDF("b", "y", "n_y", "d_y", "cut_y"), ["b", "y"])
    maybe = rows.filter((F.least("d", "d_y") >= overlap) & (F.size(F.array_intersect("cut", "cut_y")) >= F.least(overlap, F.lit(SPARE + 1))))
    maybe = saved(maybe.select("a", "b", "y", "label", "top", overlap.alias("overlap")), "maybe")
    whole = links.select("b", "a", "delta")
    rows = maybe.join(whole, ["b", "a"]).join(whole.toDF("b", "y", "delta_y"), ["b", "y"])
    return rows.filter(F.size(F.array_intersect("delta", "delta_y")) >= F.col("overlap")).select("a", "b", "y", "label", "top")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without those that have a smaller id in their component."""
    found = jaccard_components(docs, id_col, text_col, **how)
    gone = saved(found.filter("doc_id <> component_id").select("doc_id"), "gone")
    return without(docs, id_col, gone)
