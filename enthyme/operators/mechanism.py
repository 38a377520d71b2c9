"""Causal chains, many maps at once: every table carries map_id.

  states(map_id, id, ord, role)                       role: intervention, condition, outcome or null
  steps(map_id, src, dst, sign, regime, jointly ARRAY, unless ARRAY)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised


def edges(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, sign, regime): steps, co-causes with the step's sign and blockers with the opposite one."""
    sign = F.coalesce(F.nullif("sign", F.lit("")), F.lit("?"))
    own = steps.select("map_id", "src", "dst", sign.alias("sign"), F.coalesce("regime", F.lit("")).alias("regime"))
    with_it = steps.select("map_id", F.explode("jointly").alias("src"), "dst", sign.alias("sign"), F.coalesce("regime", F.lit("")).alias("regime"))
    against = steps.select("map_id", F.explode("unless").alias("src"), "dst", F.when(sign == "+", "-").when(sign == "-", "+").otherwise("?").alias("sign"), F.coalesce("regime", F.lit("")).alias("regime"))
    return own.unionByName(with_it).unionByName(against).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def entries(states: DataFrame, links: DataFrame) -> DataFrame:
    """(map_id, node): interventions and conditions with a step, and states led out of and never into."""
    out = links.select("map_id", F.col("src").alias("node")).distinct()
    into = links.select("map_id", F.col("dst").alias("node")).distinct()
    declared = states.filter("role IN ('intervention', 'condition')").select("map_id", F.col("id").alias("node"))
    known = states.select("map_id", F.col("id").alias("node"))
    return out.join(declared, ["map_id", "node"], "left_semi").union(out.join(into, ["map_id", "node"], "left_anti").join(known, ["map_id", "node"], "left_semi")).distinct()


def reached(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(map_id, node) reachable from the seeds, which count."""
    links = links.select("map_id", "src", "dst").distinct()
    seen = frontier = materialised(seeds.distinct())
    while True:
        new = frontier.join(links, (frontier["map_id"] == links["map_id"]) & (frontier["node"] == links["src"])).select(links["map_id"], F.col("dst").alias("node")).distinct()
        frontier = materialised(new.join(seen, ["map_id", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def gaps(states: DataFrame, steps: DataFrame) -> DataFrame:
    """(map_id, kind, state): where a chain does not hang together."""
    links = materialised(edges(steps))
    node = F.col("id").alias("node")
    out, into = links.select("map_id", F.col("src").alias("node")).distinct(), links.select("map_id", F.col("dst").alias("node")).distinct()
    said = lambda role: states.filter(F.col("role") == role).select("map_id", node)
    row = lambda df, kind: df.select("map_id", F.lit(kind).alias("kind"), F.col("node").alias("state"))
    key = ["map_id", "node"]
    unlinked = row(said("intervention").join(out, key, "left_anti"), "unlinked-intervention").unionByName(row(said("condition").join(out, key, "left_anti"), "unlinked-condition"))
    outcomes = said("outcome")
    unreached = row(outcomes.join(reached(links, entries(states, links)), key, "left_anti"), "unreached-outcome")
    dead = row(states.select("map_id", node).join(into, key, "left_semi").join(out, key, "left_anti").join(outcomes, key, "left_anti"), "dead-end")
    maps = states.select("map_id").distinct()
    none = lambda df, kind: maps.join(df.select("map_id").distinct(), "map_id", "left_anti").select("map_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("state"))
    started = said("intervention").union(said("condition"))
    return unlinked.unionByName(unreached).unionByName(dead).unionByName(none(started, "no-intervention")).unionByName(none(outcomes, "no-outcome"))


def firing(states: DataFrame, steps: DataFrame, fails: DataFrame | None = None, off: DataFrame | None = None, holds: DataFrame | None = None) -> DataFrame:
    """(map_id, node): states reached when some fail (map_id, id), steps are cut (map_id, src, dst) or blockers hold (map_id, id). A step
    fires if its cause and all its co-causes are reached and no held state blocks it; a state that nothing leads into is
    reached unless it fails."""
    key = ["map_id", "node"]
    live = steps
    for table, condition in ((off, ["map_id", "src", "dst"]),):
        live = live.join(table, condition, "left_anti") if table is not None else live
    if fails is not None:
        for end in ("src", "dst"):
            live = live.join(fails.select("map_id", F.col("id").alias(end)), ["map_id", end], "left_anti")
    if holds is not None:
        blocked = live.select("map_id", "src", "dst", F.explode("unless").alias("id")).join(holds, ["map_id", "id"], "left_semi").select("map_id", "src", "dst")
        live = live.join(blocked, ["map_id", "src", "dst"], "left_anti")
    co = F.array_distinct(F.concat(F.array("src"), F.filter("jointly", lambda j: j != F.col("dst"))))
    rules = materialised(live.select("map_id", "dst", F.xxhash64("src", "dst", "jointly", "unless").alias("rule"), co.alias("co")))
    needs = rules.select("map_id", "rule", "dst", F.explode("co").alias("node"), F.size("co").alias("need"))
    into = steps.select("map_id", F.col("dst").alias("node")).distinct()
    start = states.select("map_id", F.col("id").alias("node")).join(into, key, "left_anti")
    if fails is not None:
        start = start.join(fails.select("map_id", F.col("id").alias("node")), key, "left_anti")
    seen = materialised(start)
    size = seen.count()
    while True:
        met = needs.join(seen, key).groupBy("map_id", "rule", "dst", "need").agg(F.count_distinct("node").alias("met")).filter("met = need")
        seen = materialised(seen.union(met.select("map_id", F.col("dst").alias("node"))).distinct())
        count = seen.count()
        if count == size:
            break
        size = count
    return seen


def undeclared(states: DataFrame, steps: DataFrame) -> DataFrame:
    """(map_id, field, name): references of steps to states that are not declared."""
    named = steps.select("map_id", F.lit("from").alias("field"), F.col("src").alias("name")).unionByName(steps.select("map_id", F.lit("to").alias("field"), F.col("dst").alias("name")))
    for field in ("jointly", "unless"):
        named = named.unionByName(steps.select("map_id", F.lit(field).alias("field"), F.explode(field).alias("name")))
    return named.filter("name IS NOT NULL").distinct().join(states.select("map_id", F.col("id").alias("name")), ["map_id", "name"], "left_anti").select("map_id", "field", "name")
