"""Rules of causal chains: each a query for the rows that break it, all of them one table (map_id, rule, severity, title, subject).

Tables as in `profile`; besides, states(map_id, id, measures, appraisal BOOLEAN, level, part_of), levels(map_id, level, parent),
chains(map_id, chain), chain_claims(map_id, chain, title).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised

# What the fields of a step may hold.
SIGNS = ("+", "-", "0", "which")
BASES = ("study", "statistics", "model", "example", "testimony", "asserted")
STANCES = ("rejected", "unjudged")
SCOPES = ("general", "singular")
NATURES = ("being", "persistence", "possibility", "chance", "stock")
ONS = ("level", "trend", "character", *NATURES)
DEPTHS = ("full", "sketch", "none")
GOALS = ("explain", "intervene", "predict", "attribute")


def broken(rows: DataFrame, rule: str, severity: str, subject: Column) -> DataFrame:
    return rows.select("map_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("title").cast("string").alias("title"), subject.cast("string").alias("subject"))


def outside(steps: DataFrame) -> list[DataFrame]:
    """Values that are not among those a field may hold; an empty field is none."""
    fields = (("sign", SIGNS, "!"), ("basis", BASES, "?"), ("stance", STANCES, "!"), ("scope", SCOPES, "?"), ("on", ONS, "!"))
    return [broken(steps.filter(F.col(c).isNotNull() & (F.col(c) != "") & ~F.col(c).isin(*known)), f"unknown-{c}", severity, F.col(c)) for c, known, severity in fields]


def references(steps: DataFrame, states: DataFrame) -> list[DataFrame]:
    """Names of states that are not declared, and those that name the step's own ends."""
    known = states.select("map_id", F.col("id").alias("name")).distinct()
    out = []
    for field in ("src", "dst", "via", "unless", "jointly"):
        ends = field in ("src", "dst")
        named = steps.select("map_id", "title", "src", "dst", (F.col(field) if ends else F.explode(field)).alias("name"))
        out.append(broken(named.filter("name IS NOT NULL").join(known, ["map_id", "name"], "left_anti"), f"undeclared-{field}", "!", F.col("name")))
        if not ends:
            out.append(broken(named.filter("name IN (src, dst)"), f"own-end-{field}", "?", F.col("name")))
    return out


def consistency(steps: DataFrame) -> list[DataFrame]:
    """Fields of one step that contradict each other."""
    pair = F.concat_ws(" > ", "src", "dst")
    return [
        broken(steps.filter("necessary AND sign IN ('-', '0')"), "necessary-against-sign", "?", pair),
        broken(steps.filter("sufficient AND sign = '0'"), "sufficient-without-effect", "?", pair),
        broken(steps.filter("sufficient AND (nul OR selects OR assoc)"), "sufficient-without-cause", "?", pair),
        broken(steps.filter("design = 'illustration' AND basis IN ('study', 'statistics', 'model')"), "illustration-as-test", "?", pair),
        broken(steps.filter("on = 'character' AND sign IN ('+', '-', '0')"), "character-with-degree", "?", pair),
        broken(steps.filter(F.col("on").isin(*NATURES) & (F.col("sign") == "which")), "nature-without-direction", "?", pair),
        broken(steps.filter("stance IS NOT NULL AND layer = 'text'"), "stance-on-own-view", "?", pair),
        broken(steps.filter("src = dst"), "self-step", "!", pair),
    ]


def through_appraisal(steps: DataFrame, states: DataFrame) -> DataFrame:
    """Steps that the text asserts through a state that only the reader brought in."""
    added = states.filter("appraisal").select("map_id", F.col("id").alias("name")).distinct()
    ends = steps.filter("layer <> 'appraisal'").select("map_id", "title", F.explode(F.array_distinct(F.array("src", "dst"))).alias("name"))
    return broken(ends.join(added, ["map_id", "name"], "left_semi"), "text-through-appraisal", "!", F.col("name"))


def undeclared_cast(steps: DataFrame, states: DataFrame) -> DataFrame:
    """Maps with steps and no declared state."""
    maps = steps.select("map_id").distinct().join(states.select("map_id").distinct(), "map_id", "left_anti").withColumn("title", F.lit(None).cast("string"))
    return broken(maps, "no-states", "!", F.lit(None))


def trees(rows: DataFrame, child: str, parent: str, rule: str) -> list[DataFrame]:
    """Nestings (map_id, child, parent) must be trees: parents declared, none its own, no cycle."""
    rows = rows.withColumn("title", F.lit(None).cast("string"))
    up = rows.filter(F.col(parent).isNotNull())
    known = rows.select("map_id", F.col(child).alias(parent)).distinct()
    lost = broken(up.join(known, ["map_id", parent], "left_anti"), f"{rule}-undeclared", "!", F.col(parent))
    selfish = broken(up.filter(F.col(child) == F.col(parent)), f"{rule}-self", "!", F.col(child))
    # what reaches itself: ancestors of all nodes, doubled until nothing is new
    pairs = materialised(up.filter(F.col(child) != F.col(parent)).select("map_id", F.col(child).alias("a"), F.col(parent).alias("b")).distinct())
    n = pairs.count()
    while True:
        far = pairs.join(pairs.select("map_id", F.col("a").alias("b"), F.col("b").alias("c")), ["map_id", "b"]).select("map_id", "a", F.col("c").alias("b"))
        pairs = materialised(pairs.union(far).distinct())
        if (now := pairs.count()) == n:
            break
        n = now
    cycle = broken(pairs.filter("a = b").withColumn("title", F.lit(None).cast("string")), f"{rule}-cycle", "!", F.col("a"))
    return [lost, selfish, cycle]


def via_routes(steps: DataFrame) -> list[DataFrame]:
    """Summary steps whose route is not stated hop by hop, or whose sign is not the product of the hops'. A hop with several signs or none
    leaves the product open."""
    own = steps.filter("layer = 'text' AND NOT nul AND NOT assoc AND NOT selects")
    signs = own.groupBy("map_id", "src", "dst").agg(F.when(F.count_distinct("sign") == 1, F.min("sign")).otherwise("?").alias("hop_sign"))
    rows = own.filter(F.size("via") > 0).select("map_id", "title", "src", "dst", "via", "sign").distinct()
    stops = F.concat(F.array("src"), F.col("via"), F.array("dst"))
    hops = rows.withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.size("via") + 1), lambda i: F.struct(F.element_at(stops, i).alias("x"), F.element_at(stops, i + 1).alias("y")))))
    found = hops.join(signs.select("map_id", F.col("src").alias("hx"), F.col("dst").alias("hy"), F.col("hop_sign")).withColumnRenamed("map_id", "hm"), (F.col("map_id") == F.col("hm")) & (F.col("h.x") == F.col("hx")) & (F.col("h.y") == F.col("hy")), "left")
    open_sign = F.bool_or(~F.coalesce("hop_sign", F.lit("?")).isin("+", "-"))
    product = F.when(F.count_if(F.col("hop_sign") == "-") % 2 == 1, "-").otherwise("+")
    each = found.groupBy("map_id", "title", "src", "dst", "via", "sign").agg(F.bool_or(F.col("hop_sign").isNull()).alias("lost"), F.when(open_sign, "?").otherwise(product).alias("net"))
    pair = F.concat_ws(" > ", "src", "dst")
    return [
        broken(each.filter("lost"), "via-not-stated", "?", pair),
        broken(each.filter("NOT lost AND net IN ('+', '-') AND sign IN ('+', '-') AND net <> sign"), "via-against-sign", "?", pair),
    ]


def chain_rules(chains: DataFrame, chain_claims: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """Claims of a chain that is not declared, and declared chains without a step."""
    unknown = broken(chain_claims.join(chains.select("map_id", "chain").distinct(), ["map_id", "chain"], "left_anti"), "unknown-chain", "!", F.col("chain"))
    stepped = chain_claims.join(steps.select("map_id", "title").distinct(), ["map_id", "title"], "left_semi").select("map_id", "chain").distinct()
    idle = chains.select("map_id", "chain").distinct().join(stepped, ["map_id", "chain"], "left_anti").withColumn("title", F.lit(None).cast("string"))
    return [unknown, broken(idle, "chain-without-step", "?", F.col("chain"))]


def constitutive(constitutions: DataFrame, states: DataFrame) -> list[DataFrame]:
    """Ends declared, and no state that makes up itself."""
    known = states.select("map_id", F.col("id").alias("name")).distinct()
    ends = constitutions.select("map_id", "title", F.explode(F.array_distinct(F.array("src", "dst"))).alias("name"))
    return [broken(ends.join(known, ["map_id", "name"], "left_anti"), "constitution-undeclared", "!", F.col("name")), broken(constitutions.filter("src = dst"), "constitution-self", "!", F.col("src"))]


def appraisal_claims(claims: DataFrame, premises: DataFrame) -> list[DataFrame]:
    """Claims (map_id, title, fidelity, warrant) of the appraisal are imputed with a warrant, and never premises (map_id, title) of the author's."""
    bare = claims.filter("coalesce(fidelity, '') <> 'imputed' OR coalesce(warrant, '') = ''")
    return [broken(bare, "appraisal-not-imputed", "!", F.col("title")), broken(claims.join(premises, ["map_id", "title"], "left_semi"), "appraisal-as-premise", "!", F.col("title"))]


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()
