"""Where the claims of a text stand, and how far its reasons reach: ranks, reaches, profiles by band, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from ..plans.tables import materialised

# Bins of a profile, the least that is worth naming, the power that lifts the middle of a range.
FEWEST_BINS, MOST_BINS, ROWS_A_BIN = 8, 24, 4
LEAST_NAMED, SHARE_NAMED, POWER = 3, 0.08, 0.55
LATE, EARLY, LEANS = 0.62, 0.42, 0.2


def bin_count(n: Column) -> Column:
    return F.greatest(F.lit(FEWEST_BINS), F.least(F.lit(MOST_BINS), F.floor(n / ROWS_A_BIN + 0.5))).cast("int")


def significant(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_NAMED), F.floor(n * SHARE_NAMED + 0.5)).cast("int")


def amplified(v: Column, ref: Column) -> Column:
    return F.when(ref > 0, F.least(F.lit(1.0), F.pow(v / ref, F.lit(POWER)))).otherwise(0.0)


def ranks(nodes: DataFrame) -> DataFrame:
    """(map_id, node, rank) from 0 by place (map_id, node, pos), nodes without a place excluded; equal places by node."""
    placed = nodes.filter("pos IS NOT NULL")
    return placed.select("map_id", "node", (F.row_number().over(Window.partitionBy("map_id").orderBy("pos", "node")) - 1).alias("rank"))


def reaches(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(map_id, src, dst, at, reach): where a reason stands (src), and how many ranks lie from its claim (dst) to it; positive: after it."""
    a = ranked.select("map_id", F.col("node").alias("src"), F.col("rank").alias("at"))
    b = ranked.select("map_id", F.col("node").alias("dst"), F.col("rank").alias("to"))
    return edges.select("map_id", "src", "dst").join(a, ["map_id", "src"]).join(b, ["map_id", "dst"]).select("map_id", "src", "dst", "at", (F.col("at") - F.col("to")).alias("reach"))


def extent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("map_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))


def verdict(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(map_id, centre, lean, settles): where the justifying is done as a share of the text (map_id, n), and whether claims come first (+1) or
    reasons do (-1)."""
    w = F.abs("reach") / F.col("n")
    each = rows.join(sizes, "map_id").groupBy("map_id").agg(F.sum(w).alias("w"), F.sum(F.col("at") / F.col("n") * w).alias("c"), F.sum(F.when(F.col("reach") > 0, w).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("reach") > 0, 0.0).otherwise(w)).alias("down"))
    centre = F.when(F.col("w") > 0, F.col("c") / F.col("w"))
    lean = F.when(F.col("w") > 0, (F.col("up") - F.col("down")) / (F.col("up") + F.col("down"))).otherwise(0.0)
    return each.select("map_id", centre.alias("centre"), lean.alias("lean"), F.when(centre > LATE, "late").when(centre < EARLY, "early").when(centre.isNotNull(), "throughout").alias("settles"))


def by_band(nodes: DataFrame) -> DataFrame:
    """(map_id, band, nodes, placed) of (map_id, band, node, pos); band null: the whole text."""
    return nodes.groupingSets([("map_id", "band"), ("map_id",)], "map_id", "band").agg(F.count("*").alias("nodes"), F.count("pos").alias("placed"))


def occurrence(found: DataFrame) -> DataFrame:
    """(quote_id, line): of places (quote_id, line, front, pinned, abstract) the one outside front matter, on a pinned page and outside the
    abstract, each if there is any, then the earliest line."""
    order = Window.partitionBy("quote_id").orderBy("front", F.desc("pinned"), "abstract", "line")
    return found.withColumn("k", F.row_number().over(order)).filter("k = 1").select("quote_id", "line")


def table_labels(text: Column) -> Column:
    """The tables that a text names, in order of first mention."""
    from ..functions.cleaning import TABLE_LABEL
    from ..functions.text import as_in_sql

    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(as_in_sql(TABLE_LABEL)), 1))


def depths(edges: DataFrame, apexes: DataFrame) -> DataFrame:
    """(node, depth): how many steps beneath an apex (column node) along dst -> src, for edges with any type of key."""
    from .graph import distances

    return distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), apexes).withColumnRenamed("dist", "depth")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, fingerprint) of (map_id, node) and (map_id, src, dst, kind): FNV-1a of the sorted nodes and edges."""
    n = nodes.groupBy("map_id").agg(F.array_join(F.array_sort(F.collect_set("node")), "\n").alias("n"))
    e = edges.groupBy("map_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\t", "src", "dst", "kind"))), "\n").alias("e"))
    return n.join(e, "map_id", "left").select("map_id", fnv1a(F.concat_ws("\n\n", "n", F.coalesce("e", F.lit("")))).alias("fingerprint"))


# Fixed value: how a title denies.
DENIAL = r"(?i)\b(?:not|no|never|cannot|n't|nor|neither|without)\b"


def denies(a: Column, b: Column) -> Column:
    """Whether one of two titles is negated and the other is not, with a content word in common."""
    from ..functions.text import as_in_sql, content_words

    negated = lambda c: F.regexp_like(c, F.lit(as_in_sql(DENIAL)))
    return (negated(a) != negated(b)) & F.arrays_overlap(content_words(a), content_words(b))


def inconsistent(named: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, name, members): sets named (map_id, name, node), and contradictory or contrary pairs that no named set holds."""
    sets = named.groupBy("map_id", "name").agg(F.array_sort(F.collect_set("node")).alias("members"))
    pairs = edges.filter("kind IN ('contradictory', 'contrary') AND src <> dst").select("map_id", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    held = named.withColumnRenamed("node", "x").join(named.withColumnRenamed("node", "y"), ["map_id", "name"]).select("map_id", "x", "y").distinct()
    alone = pairs.join(held, ["map_id", "x", "y"], "left_anti").select("map_id", F.lit(None).cast("string").alias("name"), F.array("x", "y").alias("members"))
    return sets.unionByName(alone)


def foldable(steps: DataFrame, states: DataFrame) -> DataFrame:
    """(map_id, layer, state): states without a role that a layer runs both into and out of."""
    into, out = (steps.select("map_id", "layer", F.col(end).alias("state")).distinct() for end in ("dst", "src"))
    roled = states.filter("role IS NOT NULL").select("map_id", F.col("id").alias("state"))
    return into.intersect(out).join(roled, ["map_id", "state"], "left_anti").select("map_id", "layer", "state")


def folded(steps: DataFrame, states: DataFrame) -> DataFrame:
    """Steps (map_id, layer, src, dst, sign, tier) after the states (map_id, state) are folded: what led into a folded state and what led out of it
    are composed within a layer. The sign is the product, ? if either is open; the tier (0 best) the worse; of equal steps the
    best stays. A state at a time goes, in order; loops that would close are left out."""
    now = materialised(steps.select("map_id", "layer", "src", "dst", "sign", "tier").distinct())
    gone = states.select("map_id", "state").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("map_id").orderBy("state")))
    turns = gone.agg(F.max("turn")).first()[0] or 0
    for turn in range(1, turns + 1):
        this = gone.filter(F.col("turn") == turn).select("map_id", F.col("state").alias("mid"))
        ins = now.join(this, "map_id").filter("dst = mid AND src <> mid").select("map_id", "layer", "mid", "src", F.col("sign").alias("s1"), F.col("tier").alias("t1"))
        outs = now.join(this, "map_id").filter("src = mid AND dst <> mid").select("map_id", "layer", "mid", "dst", F.col("sign").alias("s2"), F.col("tier").alias("t2"))
        sign = F.when(F.col("s1").isin("+", "-") & F.col("s2").isin("+", "-"), F.when(F.col("s1") == F.col("s2"), "+").otherwise("-")).otherwise("?")
        made = ins.join(outs, ["map_id", "layer", "mid"]).filter("src <> dst").select("map_id", "layer", "src", "dst", sign.alias("sign"), F.greatest("t1", "t2").alias("tier"))
        kept = now.join(this, "map_id", "left").filter("mid IS NULL OR (src <> mid AND dst <> mid)").select(now.columns)
        now = materialised(kept.unionByName(made).groupBy("map_id", "layer", "src", "dst", "sign").agg(F.min("tier").alias("tier")))
    return now


def unknown_keys(data: DataFrame, known: list[str]) -> DataFrame:
    """(map_id, title, key): keys of metadata (map_id, title, data MAP) that nothing reads."""
    return data.select("map_id", "title", F.explode(F.map_keys("data")).alias("key")).filter(~F.col("key").isin(*known)).distinct()


def warrants(claims: DataFrame) -> DataFrame:
    """(map_id, warrant, n): departures from the author's words (fidelity inferred or imputed) by their warrant, null where there is none."""
    return claims.filter("fidelity IN ('inferred', 'imputed')").groupBy("map_id", F.nullif("warrant", F.lit("")).alias("warrant")).agg(F.count("*").alias("n"))


def yaml_string(v: Column) -> Column:
    """A text as a double-quoted scalar."""
    escaped = F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit('"'))
