"""Graph measures by bounded fixpoints on edge tables: (src, dst) with any type of key.

A round is one join and one aggregation on the frontier only; rounds are written to the shared folder, so a plan does not
grow and a lost executor costs one round. The number of rounds is the depth of the graph, not the number of nodes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised

ATTACKS = ("attack", "undercut", "contradictory", "contrary")


def distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, dist): fewest edges from a seed (column node) along src -> dst."""
    edges = materialised(edges.select("src", "dst").distinct())
    n_files = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = frontier = materialised(seeds.select("node").distinct().withColumn("dist", F.lit(0)))
    for step in count(1):
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialised(reached.join(seen, "node", "left_anti").withColumn("dist", F.lit(step)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if step % 8 == 0:  # a few files to read, however deep the graph
            seen = materialised(seen.coalesce(n_files))
    return seen


def contribution(edges: DataFrame) -> DataFrame:
    """(node, role, dist, dist_support): edges are (src, dst, kind), src bearing on dst. apex: bears on nothing and something bears on it;
    supports: reaches an apex by support; engages: only with an attack on the way; inert: reaches none. A contradiction bears on
    neither side."""
    edges = materialised(edges.select("src", "dst", "kind").filter("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    bearing = edges.filter("kind <> 'contradictory'").select(F.col("src").alias("node")).distinct()
    borne = edges.select(F.col("dst").alias("node")).union(edges.filter("kind = 'contradictory'").select("src")).distinct()
    apex = borne.join(bearing, "node", "left_anti")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    by_any = distances(back, apex)
    by_support = distances(back.filter("kind = 'support'"), apex).withColumnRenamed("dist", "dist_support")
    role = F.when(F.col("dist") == 0, "apex").when(F.col("dist_support").isNotNull(), "supports").when(F.col("dist").isNotNull(), "engages").otherwise("inert")
    return nodes.join(by_any, "node", "left").join(by_support, "node", "left").select("node", role.alias("role"), "dist", "dist_support")


def closure_sizes(edges: DataFrame) -> DataFrame:
    """(node, load): how many nodes lie beneath a node, along dst -> src. Pairs (node, beneath) grow by doubling, so the rounds are
    the logarithm of the depth; on a graph with long chains the pairs, not the rounds, are the cost."""
    pairs = materialised(edges.select(F.col("dst").alias("top"), F.col("src").alias("below")).filter("top <> below").distinct())
    size = pairs.count()
    while True:
        more = pairs.alias("a").join(pairs.alias("b"), F.col("a.below") == F.col("b.top")).select("a.top", "b.below")
        pairs = materialised(pairs.union(more).distinct())
        now = pairs.count()
        if now == size:
            break
        size = now
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(pairs.filter("top <> below").groupBy(F.col("top").alias("node")).agg(F.count("*").alias("load")), "node", "left").select("node", F.coalesce("load", F.lit(0)).alias("load"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached, whatever the direction. In each round every node goes into the one next to it, or itself, that comes first in
    an order drawn anew, and the edges between what is left are made distinct; so a hub takes in its neighbours at once and a chain halves, about.
    A node's edges are never brought together: an end is replaced first, and few edges are left when the other end meets its place."""
    rest = materialised(edges.select("src", "dst"))
    nodes, steps = materialised(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()), []
    rest = rest.filter("src <> dst")
    for k in count():
        order = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        sides = [rest.groupBy(F.col(x).alias("node")).agg(F.min(order(y)).alias("near")) for x, y in (("src", "dst"), ("dst", "src"))]
        near = sides[0].unionByName(sides[1]).groupBy("node").agg(F.min("near").alias("near"))
        into = materialised(near.select("node", F.least("near", order("node"))["node"].alias("into")))
        ends = lambda c: into.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: B023, E731
        half = rest.join(ends("src"), "src").select(F.col("src_into").alias("src"), "dst").distinct()
        rest = materialised(half.join(ends("dst"), "dst").select(F.least("src", "dst_into").alias("src"), F.greatest("src", "dst_into").alias("dst")).filter("src <> dst").distinct())
        steps.append(into)
        if rest.isEmpty():
            break
    roots = steps.pop()
    for into in reversed(steps):  # where the nodes of a round went in the end; a node without edges then stays
        after = roots.select(F.col("node").alias("into"), F.col("into").alias("root"))
        roots = materialised(into.join(after, "into", "left").select("node", F.coalesce("root", "into").alias("into")))
    placed = materialised(nodes.join(roots, "node", "left").select("node", F.coalesce("into", "node").alias("root")))
    return placed.join(placed.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def systems(edges: DataFrame) -> DataFrame:
    """(node, system): sets of two nodes or more that all reach each other, named by the smallest. By mutual reachability, so for
    the graphs of cases and mechanisms, which are small; many of them go in one call when src and dst carry the graph's key."""
    pairs = materialised(edges.select("src", "dst").distinct())
    size = pairs.count()
    while True:
        pairs = materialised(pairs.union(pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct())
        now = pairs.count()
        if now == size:
            break
        size = now
    mutual = pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    named = mutual.groupBy("src").agg(F.min("dst").alias("system"), F.count_distinct("dst").alias("n"))
    return named.filter("n > 1").select(F.col("src").alias("node"), "system")


FLIP = {"+": "-", "-": "+"}


def net_sign(signs: Column) -> Column:
    """The sign of a run of steps: the product, or ? if a step has none or both."""
    unsure = F.exists(signs, lambda s: ~s.isin("+", "-"))
    return F.when(unsure, "?").when(F.size(F.filter(signs, lambda s: s == "-")) % 2 == 1, "-").otherwise("+")


def routes(steps: DataFrame, starts: DataFrame, goals: DataFrame, most: int | None = None) -> DataFrame:
    """(start, goal, path, signs, regimes): simple routes, of up to `most` steps if that is given; else the search ends when no path
    grows. steps are (src, dst, sign, regime); a route stays in one regime, and a step with an empty regime holds in all. Paths grow one step a round, all starts together."""
    steps = steps.select("src", "dst", "sign", "regime").distinct()
    goals = goals.select(F.col("node").alias("goal")).distinct()
    paths = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.array().cast("array<string>").alias("signs"), F.lit("").alias("regime")).distinct()
    found = None
    for _ in count() if most is None else range(most):
        last = F.element_at("path", -1)
        grown = paths.withColumn("at", last).join(steps.withColumnRenamed("regime", "step_regime"), F.col("at") == F.col("src"))
        grown = grown.filter(~F.array_contains("path", F.col("dst")) & ((F.col("regime") == "") | (F.col("step_regime") == "") | (F.col("regime") == F.col("step_regime"))))
        grown = grown.select("start", F.concat("path", F.array("dst")).alias("path"), F.concat("signs", F.array("sign")).alias("signs"), F.when(F.col("regime") == "", F.col("step_regime")).otherwise(F.col("regime")).alias("regime"))
        grown = materialised(grown)
        if grown.isEmpty():
            break
        done = grown.join(goals, F.element_at("path", -1) == F.col("goal")).select("start", "goal", "path", "signs", "regime")
        found = done if found is None else found.unionByName(done)
        paths = grown.join(goals, F.element_at("path", -1) == F.col("goal"), "left_anti")
    if found is None:
        found = starts.select(F.col("node").alias("start")).join(goals).select("start", "goal", F.array("start").alias("path"), F.array().cast("array<string>").alias("signs"), F.lit("").alias("regime")).filter("false")
    return found


def loops(steps: DataFrame, most: int | None = None) -> DataFrame:
    """(loop, signs): simple cycles, of up to `most` steps if that is given, each once, from its smallest node. Without it the
    search ends when no path grows, after as many rounds as there are nodes at most."""
    steps = steps.select("src", "dst", "sign").distinct()
    nodes = steps.select(F.col("src").alias("node")).distinct()
    paths = nodes.select(F.col("node").alias("start"), F.array("node").alias("path"), F.array().cast("array<string>").alias("signs"))
    found = None
    for _ in count() if most is None else range(most):
        grown = paths.withColumn("at", F.element_at("path", -1)).join(steps, F.col("at") == F.col("src"))
        grown = materialised(grown.filter(F.col("dst") >= F.col("start")).select("start", "path", "dst", F.concat("signs", F.array("sign")).alias("signs")))
        if grown.isEmpty():
            break
        closed = grown.filter("dst = start").select(F.col("path").alias("loop"), "signs")
        found = closed if found is None else found.unionByName(closed)
        paths = grown.filter(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path"), "signs")
    return found if found is not None else paths.select(F.col("path").alias("loop"), "signs").filter("false")
