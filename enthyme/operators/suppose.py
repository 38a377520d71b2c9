"""What holds under a supposition: least fixed point of an AND-OR support structure, many scenarios at once.

Statements hold by any line of support (OR); an argument goes through if all its inputs hold (AND); a statement without
support is basic and holds unless denied. Attacks do nothing until they are turned on: a held attacker denies its target.

Tables, each with a scenario-free key:
  statements(id), arguments(arg, concludes), inputs(arg, input), attacks(src, dst)
  suppositions(scenario, id, holds BOOLEAN), cuts(scenario, arg)
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised, small


def closed(suppositions: DataFrame, attacks: DataFrame) -> DataFrame:
    """Suppositions with what they deny: the targets of held attackers that are not held themselves."""
    held = suppositions.filter("holds").select("scenario", "id")
    hit = held.join(attacks, held["id"] == attacks["src"]).select("scenario", F.col("dst").alias("id")).distinct()
    denied = hit.join(held, ["scenario", "id"], "left_anti").withColumn("holds", F.lit(False))
    return suppositions.select("scenario", "id", "holds").unionByName(denied).groupBy("scenario", "id").agg(F.min("holds").alias("holds"))


def grounded(statements: DataFrame, arguments: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rank) of what holds without any supposition and (arg, concludes, rank) of the arguments that go through: the round in which they first do.
    An input is joined once, when it comes to hold; inputs met are counted against inputs, so repeated rows count on both sides."""
    need = inputs.groupBy("arg").agg(F.count("*").alias("need"))
    lines = materialised(arguments.select("arg", "concludes").join(need, "arg", "left").select("arg", "concludes", F.coalesce("need", F.lit(0)).alias("need")))
    new = materialised(statements.select("id").distinct().join(lines.select(F.col("concludes").alias("id")), "id", "left_anti"))
    held, fired, met = new.withColumn("rank", F.lit(0)), lines.filter("need = 0").select("arg", "concludes", F.lit(1).alias("rank")), None
    now = fired
    for rank in count(1):
        more = inputs.join(small(new.withColumnRenamed("id", "input")), "input").groupBy("arg").agg(F.count("*").alias("n"))
        met = materialised(more.withColumn("fresh", F.lit(True)) if met is None else met.withColumn("fresh", F.lit(False)).unionByName(more.withColumn("fresh", F.lit(True))).groupBy("arg").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")))
        goes = materialised(met.filter("fresh").join(lines, "arg").filter("n = need").select("arg", "concludes", F.lit(rank).alias("rank")))
        met = met.drop("fresh")
        fired, now = fired.unionByName(goes), goes if rank > 1 else now.unionByName(goes)
        new = materialised(now.select(F.col("concludes").alias("id")).distinct().join(held, "id", "left_anti"))
        if new.isEmpty():
            return held, fired
        held = held.unionByName(new.withColumn("rank", F.lit(rank)))


def differing(statements: DataFrame, arguments: DataFrame, inputs: DataFrame, suppositions: DataFrame, cuts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id), (scenario, id), (scenario, id): what holds without any supposition, and what each scenario takes from that and adds to it.

    Only rows that a scenario changes are made. First what falls: a statement whose arguments of its own round or before all fail. These rest on earlier
    rounds only, so circles do not keep each other up. Then what comes back by a later argument or is supposed: its arguments are looked at whole, until nothing is added."""
    said = materialised(suppositions.select("scenario", "id", "holds"))
    denied, supposed = said.filter("NOT holds").select("scenario", "id").distinct(), said.filter("holds").select("scenario", "id").distinct()
    both, key = ["scenario", "id"], ["scenario", "arg"]
    base, fired = (materialised(t) for t in grounded(statements, arguments, inputs))
    gone = materialised(cuts.select(*key).distinct()) if cuts is not None else None
    rests = fired.join(base.select(F.col("id").alias("concludes"), F.col("rank").alias("first")), "concludes").select("arg", "concludes", (F.col("rank") <= F.col("first")).alias("own"))
    rests = materialised(rests)
    props = materialised(rests.groupBy(F.col("concludes").alias("id")).agg(F.count_if("own").alias("own"), F.count("*").alias("props")))
    # what falls
    new = materialised(denied.join(supposed, both, "left_anti").join(base.select("id"), "id"))
    lost, dead, failed = new, None, None
    first = True
    while first or not new.isEmpty():
        hit = inputs.join(small(new.withColumnRenamed("id", "input")), "input").select(*key)
        hit = (hit.unionByName(gone) if first and gone is not None else hit).distinct()
        hit = materialised(hit if dead is None else hit.join(dead, key, "left_anti"))
        dead = hit if dead is None else dead.unionByName(hit)
        more = hit.join(rests, "arg").groupBy("scenario", F.col("concludes").alias("id")).agg(F.count_if("own").alias("own_failed"), F.count("*").alias("failed"))
        failed = materialised(more if failed is None else failed.unionByName(more).groupBy(*both).agg(F.sum("own_failed").alias("own_failed"), F.sum("failed").alias("failed")))
        new = materialised(failed.join(props, "id").filter("own_failed = own").select(*both).join(supposed, both, "left_anti").join(lost, both, "left_anti"))
        lost, first = lost.unionByName(new), False
    lost = materialised(lost)
    # what comes back, and what is added
    back = lost.join(failed, both).join(props, "id").filter("failed < props").select(*both).join(denied, both, "left_anti")
    new = materialised(back.unionByName(supposed.join(base.select("id"), "id", "left_anti").select(*both)).distinct())
    added, need = new, None
    while not new.isEmpty():
        need = materialised(inputs.groupBy("arg").agg(F.count("*").alias("need"))) if need is None else need
        asked = new.withColumnRenamed("id", "input").join(inputs, "input").select(*key).distinct()
        asked = materialised(asked if gone is None else asked.join(gone, key, "left_anti"))
        parts = asked.join(inputs, "arg").select(*key, F.col("input").alias("id"))
        stand = parts.join(base.select("id"), "id", "left_semi").join(lost, both, "left_anti").select(*key).unionAll(parts.join(added, both, "left_semi").select(*key))
        goes = stand.groupBy(*key).agg(F.count("*").alias("n")).join(need, "arg").filter("n = need").join(arguments.select("arg", F.col("concludes").alias("id")), "arg").select(*both).distinct()
        holds = base.select("id").join(lost, "id").select(*both)  # of what held, only what fell can come back
        goes = goes.join(denied, both, "left_anti").join(added, both, "left_anti")
        new = materialised(goes.join(holds, both, "left_semi").unionByName(goes.join(base.select("id"), "id", "left_anti").select(*both)))
        added = materialised(added.unionByName(new))
    fallen = lost.join(added, both, "left_anti")
    return base.select("id"), fallen, added.join(base.select("id"), "id", "left_anti").select(*both)


def holding(statements: DataFrame, arguments: DataFrame, inputs: DataFrame, suppositions: DataFrame, scenarios: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(scenario, id) of the statements that hold in each scenario."""
    held, fallen, added = differing(statements, arguments, inputs, suppositions, cuts)
    live = scenarios.select("scenario").distinct()
    here = lambda rows: rows.join(live, "scenario", "left_semi").select("scenario", "id")
    return live.join(held, how="cross").select("scenario", "id").join(fallen, ["scenario", "id"], "left_anti").unionByName(here(added))


def losses(before: DataFrame, after: DataFrame, denied: DataFrame) -> DataFrame:
    """(scenario, id): held before, not after, and not itself denied. before has no scenario."""
    scenarios = denied.select("scenario").distinct()
    return scenarios.join(before.select("id"), how="cross").join(after, ["scenario", "id"], "left_anti").join(denied.select("scenario", "id"), ["scenario", "id"], "left_anti")


def not_holding(statements: DataFrame, arguments: DataFrame, inputs: DataFrame, suppositions: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(scenario, id): the statements that do not hold in a scenario and are not themselves denied in it, as losses of all statements has them. What holds in a
    scenario is not listed."""
    held, fallen, added = differing(statements, arguments, inputs, suppositions, cuts)
    denied, both = suppositions.filter("NOT holds").select("scenario", "id"), ["scenario", "id"]
    never = denied.select("scenario").distinct().join(statements.select("id").join(held, "id", "left_anti"), how="cross").select(*both)
    rows = fallen.select(*both).join(denied.select("scenario").distinct(), "scenario", "left_semi").unionByName(never.join(added, both, "left_anti"))
    return rows.join(denied, both, "left_anti")
