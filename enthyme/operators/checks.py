"""Findings about maps: each check is a query for the rows that break it, and all of them are one table.

(map_id, check, severity, message): `!` is a fault, `?` is something to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import decided
from ..functions.text import stamp
from ..sources import maps
from . import graph


def finding(rows: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return rows.select("map_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))


def parse_faults(parsed: DataFrame) -> DataFrame:
    return finding(maps.faults(parsed), "parse", "!", F.concat(F.lit("line "), "line", F.lit(": "), "message"))


def disconnected(parsed: DataFrame) -> DataFrame:
    """Claims with no relation and no place in a structure."""
    used = maps.title_edges(parsed).select("map_id", F.col("src").alias("title")).union(maps.title_edges(parsed).select("map_id", "dst")).union(maps.pcs_lines(parsed).select("map_id", "title")).distinct()
    return finding(maps.claims(parsed).join(used, ["map_id", "title"], "left_anti"), "disconnected", "!", F.col("title"))


def statement_undercuts(parsed: DataFrame) -> DataFrame:
    return finding(maps.relations(parsed).filter("type = 'undercut' AND dst_type = 'statement'"), "statement-undercut", "!", F.concat_ws(" > ", "src", "dst"))


def thin_steps(parsed: DataFrame) -> DataFrame:
    """Conclusions drawn from one line or none."""
    p = maps.pcs_lines(parsed)
    premises = p.filter("role = 'premise'").groupBy("map_id", "arg", (F.col("step") + 1).alias("step")).agg(F.count("*").alias("given"))
    carried = p.filter("role <> 'premise'").select("map_id", "arg", (F.col("step") + 1).alias("step"), F.lit(1).alias("c"))
    key = ["map_id", "arg", "step"]
    steps = p.filter("role <> 'premise'").join(premises, key, "left").join(carried, key, "left")
    thin = steps.filter(F.coalesce("given", F.lit(0)) + F.coalesce("c", F.lit(0)) <= 1)
    return finding(thin, "thin-step", "?", F.concat_ws(": ", "arg", "title"))


def inert(parsed: DataFrame) -> DataFrame:
    """Claims that reach no contention by any route."""
    e = maps.title_edges(parsed)
    roles = graph.contribution(e.select(F.struct("map_id", F.col("src").alias("t")).alias("src"), F.struct("map_id", F.col("dst").alias("t")).alias("dst"), "kind"))
    return finding(roles.filter("role = 'inert'").select("node.map_id", F.col("node.t").alias("title")), "inert", "?", F.col("title"))


DATA = "title string, type string, data struct<formalization: string, formalized: string, source: string, fidelity: string, warrant: string>"


def data(parsed: DataFrame) -> DataFrame:
    """(map_id, title, formalization, formalized, source, fidelity, warrant) of the metadata blocks, the first that gives a value."""
    d = parsed.filter("kind = 'data'").select("map_id", "line", F.from_json("body", DATA).alias("b")).select("map_id", "line", "b.title", "b.data.*")
    pick = [F.min(F.when(F.col(c).isNotNull(), F.struct("line", c)))[c].alias(c) for c in ("formalization", "formalized", "source", "fidelity", "warrant")]
    return d.groupBy("map_id", "title").agg(*pick)


def stale_formalizations(parsed: DataFrame) -> DataFrame:
    """A formula whose stamp is not that of the claim's words any more."""
    d = data(parsed).filter("formalization IS NOT NULL AND formalized IS NOT NULL").join(maps.claims(parsed).select("map_id", "title", "text"), ["map_id", "title"])
    return finding(d.filter(stamp(F.col("text")) != F.col("formalized")), "stale-formalization", "!", F.col("title"))


def invalid_steps(parsed: DataFrame) -> DataFrame:
    """Steps with a formula on every line that a model refutes."""
    p = maps.pcs_lines(parsed).join(data(parsed).select("map_id", "title", "formalization"), ["map_id", "title"], "left")
    used = p.filter("role = 'premise'").select("map_id", "arg", (F.col("step") + 1).alias("step"), "n", "formalization")
    carried = p.filter("role <> 'premise'").select("map_id", "arg", (F.col("step") + 1).alias("step"), "n", "formalization")
    lines = F.array_sort(F.collect_list(F.struct("n", "formalization")))
    inputs = used.unionByName(carried).groupBy("map_id", "arg", "step").agg(F.transform(lines, lambda x: x["formalization"]).alias("premises"))
    steps = p.filter("role <> 'premise' AND formalization IS NOT NULL").join(inputs, ["map_id", "arg", "step"]).filter(F.forall("premises", lambda f: f.isNotNull()))
    refuted = steps.withColumn("v", decided(F.col("premises"), F.col("formalization"))).filter("v.supported AND NOT v.valid")
    return finding(refuted, "invalid-step", "!", F.concat_ws(": ", "arg", "v.countermodel"))


# The levels of fidelity, from the author's words to the reader's.
FIDELITY = ("quotation", "paraphrase", "summary", "inferred", "imputed")


def fidelity(parsed: DataFrame) -> DataFrame:
    d = data(parsed).filter("fidelity IS NOT NULL")
    unknown = finding(d.filter(~F.col("fidelity").isin(*FIDELITY)), "fidelity", "!", F.concat_ws(": ", "title", "fidelity"))
    bare = finding(d.filter(F.col("fidelity").isin("inferred", "imputed") & F.col("warrant").isNull()), "warrant", "!", F.col("title"))
    return unknown.unionByName(bare)


ALL = (parse_faults, disconnected, statement_undercuts, thin_steps, inert, stale_formalizations, invalid_steps, fidelity)


def findings(parsed: DataFrame) -> DataFrame:
    out = None
    for check in ALL:
        out = check(parsed) if out is None else out.unionByName(check(parsed))
    return out


def census(found: DataFrame) -> DataFrame:
    """(map_id, faults, looks, checks): what a run puts into the ledger."""
    each = found.groupBy("map_id", "check", "severity").agg(F.count("*").cast("int").alias("n"))
    return each.groupBy("map_id").agg(F.coalesce(F.sum(F.when(F.col("severity") == "!", F.col("n"))), F.lit(0)).alias("faults"), F.coalesce(F.sum(F.when(F.col("severity") == "?", F.col("n"))), F.lit(0)).alias("looks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "n")))).alias("checks"))
