"""What a map says to the questions of its bridges: the steps an argument brings in carry questions, and each question names in `asks` a probe that reads what
the map records on it.

All probes are one table of items (map_id, arg, asks, said). Bridges are taken by their ends: probes over the whole map meet a bridge at the
states its steps come from or lead to, never step by step. bridges: (map_id, arg, title), a row for each premise that states a step;
steps: those of the chains, with threshold, measured_by; states: (map_id, id, role, kind, status).

Defined results: of equal items one counts; items are sorted; a premise that is no step's title brings in nothing; an unknown probe is a question for a reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised
from .profile import TIERS, causal, of_text, tier_rank

# The verb that a step is said with, and how a tier is said.
VERBS = {"": "link", "+": "raises", "-": "lowers", "0": "no effect", "which": "decides which"}
FORMATION = {"possibility": ("opens up", "closes off"), "being": ("makes", "unmakes"), "persistence": ("maintains", "erodes"), "chance": ("makes likelier", "makes less likely"), "stock": ("flows into", "flows out of")}
TIER_SAID = {"evidence": "tested", "argued": "argued for", "asserted": "asserted", "imputed": "imputed by the reconstructor"}
#: Probes whose items speak against a bridge, and all probes.
CHALLENGES = ("counter", "rivals", "otherroutes", "goals", "sideeffects", "blockers", "common", "reverse")
PROBES = (*CHALLENGES, "backing", "stops", "mediated", "measure", "kinds", "howmany", "onecase", "support", "possible", "scope", "route", "elsewhere")
BRIDGE = ["map_id", "arg"]


def named(state: Column) -> Column:
    return F.concat(F.lit("“"), state, F.lit("”"))


def verb(row) -> Column:
    """row: a function from a column's name to the column."""
    out = row("sign")
    for sign, word in VERBS.items():
        out = F.when(F.coalesce(row("sign"), F.lit("")) == sign, word).otherwise(out)
    out = F.when(row("sufficient"), "enough for").otherwise(out)
    out = F.when(row("necessary"), F.when(row("sufficient"), "needed and enough for").otherwise("needed for")).otherwise(out)
    out = F.when((row("on") == "trend") & row("sign").isin("+", "-"), F.when(row("sign") == "+", "speeds").otherwise("slows")).otherwise(out)
    for on, words in FORMATION.items():
        for sign, word in zip("+-", words, strict=True):
            out = F.when((row("on") == on) & (row("sign") == sign), word).otherwise(out)
    out = F.when((row("on") == "character") & (F.coalesce(row("sign"), F.lit("")) != ""), "transforms").otherwise(out)
    return F.when(row("nul"), "no effect").when(row("selects"), "selection effect").when(row("assoc"), "associated").otherwise(out)


def with_said(steps: DataFrame) -> DataFrame:
    v = verb(F.col)
    plain = v.isin("no effect", "selection effect", "associated")
    a, b = named(F.col("src")), named(F.col("dst"))
    return steps.withColumn("said", F.when(plain, F.concat(a, F.lit(" → "), b, F.lit(": "), v)).otherwise(F.concat(a, F.lit(" "), v, F.lit(" "), b)))


def items(rows: DataFrame, asks: str, said: Column) -> DataFrame:
    return rows.select(*BRIDGE, F.lit(asks).alias("asks"), said.alias("said")).filter("said IS NOT NULL").distinct()


def stated(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def probed(bridges: DataFrame, steps: DataFrame, states: DataFrame) -> DataFrame:
    """The items of all probes."""
    steps = materialised(with_said(steps))
    inputs = bridges.select(*BRIDGE, "title").distinct()
    own = materialised(steps.join(inputs, ["map_id", "title"]))
    froms = materialised(own.select(*BRIDGE, F.col("src").alias("state")).distinct())
    tos = materialised(own.groupBy(*BRIDGE, F.col("dst").alias("state")).agg(F.bool_or(F.col("sign") == "+").alias("rises"), F.bool_or(F.col("sign") == "-").alias("falls")))
    text = of_text(causal(steps))

    def met(rows: DataFrame, ends: DataFrame, at: str) -> DataFrame:
        """Steps that are none of a bridge's, at one of its ends."""
        return rows.join(ends.withColumnRenamed("state", at), ["map_id", at]).join(inputs, [*BRIDGE, "title"], "left_anti")

    def beyond(rows: DataFrame, ends: DataFrame, at: str) -> DataFrame:
        return rows.join(ends.select(*BRIDGE, F.col("state").alias(at)), [*BRIDGE, at], "left_anti")

    plus = lambda *parts: F.concat("said", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    each = lambda rows, column: rows.withColumn("x", F.explode(column))
    onward = beyond(met(text, froms, "src"), tos, "dst").join(states.select("map_id", F.col("id").alias("dst"), "role"), ["map_id", "dst"], "left")
    outcome = F.coalesce(F.col("role") == "outcome", F.lit(False))
    arriving = met(steps, tos, "dst")
    opposed = ((F.col("sign") == "-") & F.col("rises")) | ((F.col("sign") == "+") & F.col("falls"))
    unless = each(own, "unless")
    rival = steps.filter("layer = 'rival'").withColumn("said", F.when(stated("stance"), plus(" (", F.col("stance"), ")")).otherwise(F.col("said")))
    ends = froms.unionByName(tos.select(*froms.columns)).distinct()

    tier = F.element_at(F.array(*(F.lit(TIER_SAID[t]) for t in TIERS)), F.col("rank") + 1)
    backing = own.withColumn("rank", tier_rank(F.col("basis"), F.col("layer"))).groupBy(*BRIDGE, "rank").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("basis")), ", ").alias("bases"))
    backed = F.concat(tier, F.lit(": "), F.col("n").cast("string"), F.when(F.col("rank") == 0, F.concat(F.lit(" ("), "bases", F.lit(")"))).otherwise(""))
    counts = own.groupBy(*BRIDGE).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.nullif("regime", F.lit("")))).alias("settings"), F.array_join(F.array_sort(F.collect_set("said")), "; ").alias("all"))
    counted = F.concat(F.col("n").cast("string"), F.lit(" steps"), F.when(F.size("settings") > 0, F.concat(F.lit(", in "), F.size("settings").cast("string"), F.lit(" settings: "), F.array_join("settings", "; "))).otherwise(""))
    placed = ends.join(states.select("map_id", F.col("id").alias("state"), "kind", "status"), ["map_id", "state"])

    # a common cause: a state other than the two from which the text leads to both
    causes = text.select("map_id", F.col("src").alias("c"), "dst").distinct()
    pairs = own.select(*BRIDGE, "src", "dst").distinct()
    common = pairs.join(causes.withColumnRenamed("dst", "src"), ["map_id", "src"]).join(causes, ["map_id", "c", "dst"]).filter("c <> src AND c <> dst")
    back = steps.groupBy("map_id", "src", "dst").agg(F.min("said").alias("said")).select("map_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "said")

    parts = [
        items(unless, "counter", plus(" unless ", named(F.col("x")))),
        items(own.filter(stated("regime")), "counter", plus(", regime: ", F.col("regime"))),
        items(own.filter(stated("threshold")), "counter", plus(" past a threshold: ", F.col("threshold"))),
        items(arriving.filter("layer = 'rival'"), "counter", F.concat(F.lit("a view the text reports: "), "said")),
        items(beyond(arriving.filter((F.col("layer") == "text") & opposed), froms, "src"), "counter", F.col("said")),
        items(rival.join(ends.withColumnRenamed("state", "dst"), ["map_id", "dst"]), "rivals", F.col("said")),
        items(beyond(met(text, tos, "dst"), froms, "src"), "otherroutes", F.col("said")),
        items(onward, "elsewhere", F.col("said")),
        items(onward.filter(outcome), "goals", F.col("said")),
        items(onward.filter(~outcome), "sideeffects", F.col("said")),
        items(unless, "blockers", plus(" unless ", named(F.col("x")))),
        items(each(met(of_text(steps), froms, "src"), "unless"), "blockers", plus(" unless ", named(F.col("x")))),
        items(common, "common", F.concat(named(F.col("c")), F.lit(" leads to both "), named(F.col("src")), F.lit(" and "), named(F.col("dst")))),
        items(pairs.join(back, ["map_id", "src", "dst"]), "reverse", plus(" as well")),
        items(backing, "backing", backed),
        items(own.filter(F.size("via") > 0), "mediated", plus(" through ", F.array_join(F.transform("via", named), " → "))),
        items(own.filter(stated("regime")), "mediated", plus(", regime: ", F.col("regime"))),
        items(own.filter(stated("threshold")), "mediated", plus(" past a threshold: ", F.col("threshold"))),
        items(own.filter(stated("period")), "mediated", plus(": ", F.col("period"))),
        items(own.filter(stated("scope")), "mediated", plus(": ", F.when(F.col("scope") == "singular", "a single case").otherwise("a general relation"))),
        items(own.filter(F.size("measured_by") > 0), "measure", plus(", read from ", F.array_join(F.transform("measured_by", named), ", "))),
        items(placed.filter("kind IS NOT NULL"), "kinds", F.concat(named(F.col("state")), F.lit(" is of the kind "), named(F.col("kind")))),
        items(placed.filter("status IN ('possible', 'open')"), "possible", F.concat(named(F.col("state")), F.when(F.col("status") == "open", " cannot be specified in advance, the text says").otherwise(" is a possibility the text sets out"))),
        items(counts, "howmany", counted),
        items(counts, "route", F.col("all")),
        items(own.filter("scope = 'singular'"), "onecase", plus(" is about a single case")),
        items(own.filter(F.size("jointly") > 0), "support", plus(" only together with ", F.array_join(F.transform("jointly", named), ", "))),
        items(each(own, "given"), "support", plus(" given ", F.col("x"))),
        items(own.filter(stated("scope")), "scope", plus(": ", F.when(F.col("scope") == "singular", "a single case").otherwise("a general relation"))),
        items(own.filter(stated("regime")), "scope", plus(", regime: ", F.col("regime"))),
        items(own.filter(stated("period")), "scope", plus(": ", F.col("period"))),
        items(each(own, "given"), "scope", plus(" given ", F.col("x"))),
        chain_ends(tos, text),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def chain_ends(tos: DataFrame, text: DataFrame) -> DataFrame:
    """Where the chain goes on to from a bridge and stops; a chain that closes on itself stops nowhere."""
    links = materialised(text.select("map_id", F.col("src").alias("state"), "dst").filter("state <> dst").distinct())
    seen = materialised(tos.select(*BRIDGE, "state").distinct())
    edge = seen
    while not edge.isEmpty():
        on = edge.join(links, ["map_id", "state"]).select(*BRIDGE, F.col("dst").alias("state")).distinct()
        edge = materialised(on.join(seen, [*BRIDGE, "state"], "left_anti"))
        seen = materialised(seen.unionByName(edge))
    last = seen.join(links.select("map_id", "state").distinct(), ["map_id", "state"], "left_anti")
    where = last.groupBy(*BRIDGE).agg(F.array_join(F.transform(F.array_sort(F.collect_set("state")), named), ", ").alias("ends"))
    all_of = tos.select(*BRIDGE).distinct().join(where, BRIDGE, "left")
    said = F.when(F.col("ends").isNull(), "the chain closes on itself: every state it reaches leads on").otherwise(F.concat(F.lit("the chain goes on to "), "ends", F.lit(", and stops there")))
    return items(all_of, "stops", said)


def bridge_questions(bridges: DataFrame, questions: DataFrame, steps: DataFrame, states: DataFrame) -> DataFrame:
    """(map_id, arg, question, asks, status, n, said) of each question (question, asks; a few) to each bridge: `recorded` with the items the map has on it, `none`, or `reader`
    where no probe can tell."""
    found = probed(bridges, steps, states).groupBy(*BRIDGE, "asks").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("said")), " | ").alias("said"))
    asked = bridges.select(*BRIDGE).distinct().withColumn("q", F.explode(F.array(*(F.struct(F.lit(q).alias("question"), F.lit(a).cast("string").alias("asks")) for q, a in questions.select("question", "asks").collect()))))
    rows = asked.select(*BRIDGE, "q.question", "q.asks").join(found, [*BRIDGE, "asks"], "left")
    known = F.coalesce(F.col("asks").isin(*PROBES), F.lit(False))
    return rows.select(*BRIDGE, "question", F.when(known, F.col("asks")).alias("asks"), F.when(~known, "reader").when(F.col("n") > 0, "recorded").otherwise("none").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("said", F.lit("")).alias("said"))
