"""Views of causal chains, many maps at once: what a reader of a chain's profile asks for, one query each.

  steps(map_id, title, src, dst, sign, regime, period, size, given ARRAY, layer, stance, basis, design, scope, on, nul, assoc, selects,
        necessary, sufficient, jointly ARRAY, unless ARRAY, via ARRAY)
  constitutions(map_id, title, src, dst, layer)        relations(map_id, a, b, kind): between titles
  kinds(map_id, state, kind, general)                   layer: text, rival or appraisal

A text's own steps are those of layer `text`. Steps that find nothing (nul), associate or select are no causes. Empty words are ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialised
from . import graph, mechanism

# What the text offers for a step, and the tier it gives; nearest to evidence first.
TIERS = ("evidence", "argued", "asserted", "imputed")
TIER_OF_BASIS = {"study": "evidence", "statistics": "evidence", "model": "evidence", "example": "argued", "testimony": "argued", "asserted": "asserted"}

PAIR = ["map_id", "src", "dst"]


def causal(steps: DataFrame) -> DataFrame:
    return steps.filter("NOT nul AND NOT assoc AND NOT selects")


def of_text(steps: DataFrame) -> DataFrame:
    return steps.filter("layer = 'text'")


def tier_rank(basis: Column, layer: Column) -> Column:
    """0 for evidence to 3 for imputed; a basis that is not known is an assertion."""
    rank = F.lit(TIERS.index("asserted"))
    for b, tier in TIER_OF_BASIS.items():
        rank = F.when(basis == b, TIERS.index(tier)).otherwise(rank)
    return F.when(layer == "appraisal", TIERS.index("imputed")).otherwise(rank)


def tiers(steps: DataFrame) -> DataFrame:
    """(map_id, tier, n): how many signed pairs have that as their best tier."""
    best = causal(steps).groupBy(*PAIR, "sign").agg(F.min(tier_rank(F.col("basis"), F.col("layer"))).alias("rank"))
    name = F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank") + 1)
    return best.groupBy("map_id", name.alias("tier")).agg(F.count("*").alias("n"))


def sign_sets(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, signs): the signs stated for an edge; a co-cause has the step's, a blocker the opposite one."""
    return mechanism.edges(steps).groupBy(*PAIR).agg(F.array_sort(F.collect_set("sign")).alias("signs"))


def regime_sets(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, regimes, periods): null where a step holds in all of them."""
    some = lambda c: F.when(F.bool_or(F.col(c) == ""), None).otherwise(F.array_sort(F.collect_set(c)))
    return causal(steps).groupBy(*PAIR).agg(some("regime").alias("regimes"), some("period").alias("periods"))


def narrow(allowed: Column, stated: Column) -> Column:
    """What a route may still be in after a step: null is unconstrained, an empty array means that it ends."""
    return F.when(allowed.isNull(), stated).when(stated.isNull(), allowed).otherwise(F.array_intersect(allowed, stated))


def strata(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, records): pairs whose steps differ by condition, time or size; at least one has a condition or a period."""
    rows = of_text(steps).filter("NOT assoc AND NOT selects")
    record = F.struct("sign", "given", "period", "size")
    return rows.groupBy(*PAIR).agg(F.count_distinct(record).alias("records"), F.bool_or((F.size("given") > 0) | (F.col("period") != "")).alias("told")).filter("records > 1 AND told").drop("told")


def nulls(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, refutes, periods): the text's null findings, the signs that a rival gives the same pair, and their periods."""
    found = of_text(steps).filter("nul").groupBy(*PAIR).agg(F.array_sort(F.collect_set(F.nullif("period", F.lit("")))).alias("periods"))
    rival = steps.filter("layer = 'rival' AND NOT nul AND sign <> ''").groupBy(*PAIR).agg(F.array_sort(F.collect_set("sign")).alias("refutes"))
    return found.join(rival, PAIR, "left").select(*PAIR, F.coalesce("refutes", F.array().cast("array<string>")).alias("refutes"), "periods")


def disputed(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """(map_id, src, dst, x, y): claims x < y with steps on one pair that the argument sets against each other."""
    rows = steps.filter("NOT assoc AND NOT selects").select(*PAIR, "title").distinct()
    against = relations.filter("kind IN ('attack', 'contradictory') AND a <> b").select("map_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    # the relations lead: titles are joined one by one, no pair of steps is formed that they do not name
    with_x = against.join(rows.withColumnRenamed("title", "x"), ["map_id", "x"])
    return with_x.join(rows.withColumnRenamed("title", "y"), [*PAIR, "y"]).select(*PAIR, "x", "y")


def accounts(steps: DataFrame) -> DataFrame:
    """(map_id, state, src, title, opened_by): states into which several claims assert a step, one of them a rival's or with a stance. An
    account is opened by the other claims' steps into its cause, whose number is given."""
    rows = causal(steps).filter("layer <> 'appraisal'")
    stands = rows.groupBy("map_id", "dst").agg(F.count_distinct("title").alias("n"), F.bool_or((F.col("layer") == "rival") | F.col("stance").isNotNull()).alias("other")).filter("n > 1 AND other")
    each = rows.join(stands.select("map_id", "dst"), ["map_id", "dst"], "left_semi").select("map_id", F.col("dst").alias("state"), "src", "title").distinct()
    # steps into a cause, counted per cause and per claim: those of other claims are the difference
    into = rows.select("map_id", F.col("dst").alias("src"), F.col("src").alias("from"), "title").distinct()
    every = into.groupBy("map_id", "src").agg(F.count("*").alias("all_in"))
    own = into.groupBy("map_id", "src", "title").agg(F.count("*").alias("own_in"))
    joined = each.join(every, ["map_id", "src"], "left").join(own, ["map_id", "src", "title"], "left")
    return joined.select("map_id", "state", "src", "title", (F.coalesce("all_in", F.lit(0)) - F.coalesce("own_in", F.lit(0))).alias("opened_by"))


def akin(steps: DataFrame, kinds: DataFrame) -> DataFrame:
    """(map_id, a_src, a_dst, b_src, b_dst, instance): pairs of the text's edges whose ends are each the same state or of one kind. instance: the
    first generalises the second (each end is the other's, or the general state of its kind)."""
    edges = of_text(causal(steps)).select(*PAIR).distinct()
    of = lambda end: kinds.select("map_id", F.col("state").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("general").alias(f"{end}_general"))
    rows = edges.join(of("src"), ["map_id", "src"], "left").join(of("dst"), ["map_id", "dst"], "left")
    # states without a kind are alike only themselves
    key = lambda end: F.coalesce(F.concat(F.lit("kind "), f"{end}_kind"), F.concat(F.lit("state "), end))
    rows = rows.select(*PAIR, key("src").alias("k_src"), key("dst").alias("k_dst"), "src_general", "dst_general")
    a = rows.toDF("map_id", "a_src", "a_dst", "k_src", "k_dst", "a_sg", "a_dg")
    b = rows.toDF("map_id", "b_src", "b_dst", "k_src", "k_dst", "b_sg", "b_dg")
    pairs = a.join(b, ["map_id", "k_src", "k_dst"]).filter(F.struct("a_src", "a_dst") != F.struct("b_src", "b_dst"))
    same = lambda x, y, g: (F.col(x) == F.col(y)) | F.coalesce(F.col(x) == F.col(g), F.lit(False))
    over, under = same("a_src", "b_src", "b_sg") & same("a_dst", "b_dst", "b_dg"), same("b_src", "a_src", "a_sg") & same("b_dst", "a_dst", "a_dg")
    first = F.struct("a_src", "a_dst") < F.struct("b_src", "b_dst")
    kept = pairs.withColumn("instance", over).filter(F.when(over & under, first).otherwise(over | (~under & first)))
    return kept.select("map_id", "a_src", "a_dst", "b_src", "b_dst", "instance")


def cases(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """(map_id, src, dst, cases): how many cases of each general pair a map shows: singular steps on it, one per claim, and its instances."""
    general = of_text(steps).filter("scope = 'general'").select(*PAIR).distinct()
    same = of_text(steps).filter("scope = 'singular'").groupBy(*PAIR).agg(F.count_distinct("title").alias("s"))
    by_kind = instances.filter("instance").groupBy("map_id", F.col("a_src").alias("src"), F.col("a_dst").alias("dst")).agg(F.count("*").alias("k"))
    return general.join(same, PAIR, "left").join(by_kind, PAIR, "left").select(*PAIR, (F.coalesce("s", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("cases"))


def one_case(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """(map_id, src, dst, title): general claims from an example or a case study, where the map shows one case at most."""
    rows = of_text(steps).filter("scope = 'general' AND (basis = 'example' OR design IN ('case study', 'anecdote'))").select(*PAIR, "title").distinct()
    return rows.join(cases(steps, instances).filter("cases <= 1").select(*PAIR), PAIR, "left_semi")


def extrapolated(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst): found in a case, claimed in general."""
    of = lambda scope: of_text(steps).filter(F.col("scope") == scope).select(*PAIR)
    return of("general").intersect(of("singular"))


def common_causes(steps: DataFrame) -> DataFrame:
    """(map_id, src, dst, cause): associated pairs and the states that the text's own steps lead from into both."""
    pairs = steps.filter("assoc AND layer <> 'appraisal'").select(*PAIR).distinct()
    edges = of_text(causal(steps)).select(*PAIR).distinct()
    left = edges.select("map_id", F.col("src").alias("cause"), F.col("dst").alias("src"))
    right = edges.select("map_id", F.col("src").alias("cause"), F.col("dst").alias("dst"))
    return pairs.join(left, ["map_id", "src"]).join(right, ["map_id", "cause", "dst"]).select(*PAIR, "cause")


def transfers(steps: DataFrame) -> DataFrame:
    """(map_id, regime, src, dst, sign): steps of one regime without their like in another; maps with one regime have none."""
    rows = causal(steps).filter("regime <> ''").select("map_id", "regime", "src", "dst", "sign").distinct()
    many = rows.groupBy("map_id").agg(F.count_distinct("regime").alias("n")).filter("n > 1").select("map_id")
    alone = rows.groupBy(*PAIR, "sign").agg(F.min("regime").alias("regime"), F.count("*").alias("n")).filter("n = 1")
    return alone.join(many, "map_id", "left_semi").select("map_id", "regime", "src", "dst", "sign")


def both_ways(steps: DataFrame, constitutions: DataFrame) -> DataFrame:
    """(map_id, src, dst): caused and constituted at once, in the text's own voice."""
    return of_text(constitutions).select(*PAIR).intersect(of_text(causal(steps)).select(*PAIR))


def readings(steps: DataFrame, constitutions: DataFrame) -> DataFrame:
    """(map_id, src, dst, causal_layer, constitutive_layer): one pair read as causal in one voice and as constitutive in another."""
    a = causal(steps).filter("layer <> 'appraisal'").select(*PAIR, F.col("layer").alias("causal_layer")).distinct()
    b = constitutions.filter("layer <> 'appraisal'").select(*PAIR, F.col("layer").alias("constitutive_layer")).distinct()
    return a.join(b, PAIR).filter("causal_layer <> constitutive_layer")


def mutual(constitutions: DataFrame) -> DataFrame:
    """(map_id, x, y), x <= y: states that make each other up."""
    rows = of_text(constitutions).select(*PAIR).distinct()
    back = rows.select("map_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rows.intersect(back).select("map_id", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()


def flagged(steps: DataFrame, flag: str) -> DataFrame:
    """(map_id, src, dst, sign): distinct pairs with a flag: necessary, sufficient, nul, selects, assoc."""
    return steps.filter(F.col(flag) & (F.col("layer") != "appraisal")).select(*PAIR, "sign").distinct()


def census(steps: DataFrame, column: str) -> DataFrame:
    """(map_id, value, n): how often the text's steps have each value of a column; empty ones are not counted."""
    return of_text(steps).filter((F.col(column) != "") & F.col(column).isNotNull()).groupBy("map_id", F.col(column).alias("value")).agg(F.count("*").alias("n"))


def wholes(parts: DataFrame) -> DataFrame:
    """(map_id, whole, parts): of (map_id, state, part_of), each whole with its immediate parts."""
    return parts.filter("part_of IS NOT NULL").groupBy("map_id", F.col("part_of").alias("whole")).agg(F.array_sort(F.collect_set("state")).alias("parts"))


def kind_members(kinds: DataFrame) -> DataFrame:
    """(map_id, kind, members, general): the general state only if it is a member."""
    members = F.array_sort(F.collect_set("state"))
    rows = kinds.groupBy("map_id", "kind").agg(members.alias("members"), F.min("general").alias("general"))
    return rows.withColumn("general", F.when(F.array_contains("members", F.col("general")), F.col("general")))


def opened(steps: DataFrame) -> DataFrame:
    """(map_id, title, src, dst): summary steps whose route is stated hop by hop by other steps of the text."""
    rows = of_text(steps).filter(F.size("via") > 0).select(*PAIR, "title", "via").distinct()
    stops = F.concat(F.array("src"), F.col("via"), F.array("dst"))
    hops = rows.select(*PAIR, "title", "via", F.explode(F.transform(F.sequence(F.lit(1), F.size("via") + 1), lambda i: F.struct(F.element_at(stops, i).alias("src"), F.element_at(stops, i + 1).alias("dst")))).alias("hop"))
    stated = of_text(causal(steps)).select("map_id", F.struct("src", "dst").alias("hop"), F.lit(1).alias("said")).distinct()
    found = hops.join(stated, ["map_id", "hop"], "left").groupBy(*PAIR, "title", "via").agg(F.bool_and(F.col("said").isNotNull()).alias("whole"))
    return found.filter("whole").select("map_id", "title", "src", "dst").distinct()


def hops_of(loops: DataFrame) -> DataFrame:
    """(loop, src, dst) of every hop of loops given as arrays of states."""
    nxt = lambda i: F.element_at("loop", F.when(i == F.size("loop"), 1).otherwise(i + 1))
    return loops.select("loop").distinct().select("loop", F.explode(F.transform(F.sequence(F.lit(1), F.size("loop")), lambda i: F.struct(F.element_at("loop", i).alias("src"), nxt(i).alias("dst")))).alias("h")).select("loop", "h.*")


def sustaining(loops: DataFrame, steps: DataFrame) -> DataFrame:
    """(loop): loops of which every hop makes or maintains its next: a `+` step on being or persistence. steps: (src, dst, sign, on)."""
    keeps = steps.filter("sign = '+' AND on IN ('being', 'persistence')").select("src", "dst", F.lit(1).alias("k")).distinct()
    return hops_of(loops).join(keeps, ["src", "dst"], "left").groupBy("loop").agg(F.bool_and(F.col("k").isNotNull()).alias("all_keep")).filter("all_keep").select("loop")


def stock_loops(loops: DataFrame, steps: DataFrame) -> DataFrame:
    """(loop): loops through a flow into a stock."""
    flows = steps.filter("on = 'stock'").select("src", "dst").distinct()
    return hops_of(loops).join(flows, ["src", "dst"], "left_semi").select("loop").distinct()


def shortest_loops(steps: DataFrame, k: int = 3) -> DataFrame:
    """(system, loop, place): the k shortest of the loops that are a shortest one through some state of a feedback system, ties by their states; each
    begins at its first state. Breadth first from all states at once: a state keeps the first of the shortest paths to it, so the work is
    bounded by states times steps, however many loops there are."""
    links = steps.select("src", "dst").distinct()
    named = materialised(graph.systems(links))
    ends = links.join(named.withColumnRenamed("node", "src"), "src").join(named.select(F.col("node").alias("dst"), F.col("system").alias("other")), "dst")
    inner = materialised(ends.filter("system = other").select("src", "dst"))
    paths = named.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    seen, found = paths.select("start", "at"), None
    while not paths.isEmpty():
        grown = materialised(paths.join(inner, F.col("at") == F.col("src")).select("start", "dst", "path"))
        closed = grown.filter("dst = start").groupBy("start").agg(F.min("path").alias("path"))
        found = closed if found is None else found.unionByName(closed)
        on = grown.filter("dst <> start").join(closed.select("start"), "start", "left_anti").select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        paths = materialised(on.join(seen, ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("path").alias("path")))
        seen = materialised(seen.unionByName(paths.select("start", "at")))
    if found is None:
        return named.select("system", F.array("node").alias("loop"), F.lit(0).alias("place")).filter("false")
    first = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice(F.col("path"), first, F.size("path")), F.slice(F.col("path"), F.lit(1), first - 1))
    loops = found.select(turned.alias("loop")).distinct().join(named, F.col("loop")[0] == F.col("node")).select("system", "loop")
    place = F.row_number().over(Window.partitionBy("system").orderBy(F.size("loop"), "loop"))
    return loops.withColumn("place", place).filter(F.col("place") <= k)


def chain_profiles(chains: DataFrame, states: DataFrame, steps: DataFrame) -> DataFrame:
    """(map_id, chain, steps, states, entries, gaps) of chains (map_id, chain, title): each by the steps of its claims alone."""
    own = chains.join(steps, ["map_id", "title"]).withColumn("map_id", F.struct("map_id", "chain"))
    links = mechanism.edges(own).select("map_id", "src", "dst").distinct()
    ends = links.select("map_id", F.col("src").alias("id")).union(links.select("map_id", "dst")).distinct()
    roles = states.select(F.col("map_id").alias("m"), "id", "role")
    cast = ends.join(roles, (F.col("map_id.map_id") == F.col("m")) & (ends["id"] == roles["id"]), "left").select("map_id", ends["id"], "role")
    count = lambda df, name: df.groupBy("map_id").agg(F.count("*").alias(name))
    out = count(links, "steps").join(count(ends, "states"), "map_id", "left").join(count(mechanism.entries(cast, links), "entries"), "map_id", "left").join(count(mechanism.gaps(cast, own).filter("state IS NOT NULL"), "gaps"), "map_id", "left")
    return out.select("map_id.*", "steps", "states", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "gaps")))


def taken_up(gaps: DataFrame, steps: DataFrame, reasons: DataFrame) -> DataFrame:
    """Gaps (map_id, kind, state) whose state is an end of a step by a claim that is a reason (map_id, title) in the argument."""
    used = steps.join(reasons, ["map_id", "title"], "left_semi")
    ends = used.select("map_id", F.col("src").alias("state")).union(used.select("map_id", "dst")).distinct()
    return gaps.join(ends, ["map_id", "state"], "left_semi").select("map_id", "kind", "state")
