"""Case tables: rows (cases) by dimensions and verdicts, as a long table (case_id, frame, value).

A cell with two values is shown and never compared; `impossible` and `indeterminate` fill a cell and are never compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialised

SAID = ("impossible", "indeterminate")


def single(cells: DataFrame) -> DataFrame:
    """Cells that can be compared: one value, and not one that only says why there is none."""
    one = cells.groupBy("case_id", "frame").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return one.filter((F.col("n") == 1) & ~F.col("value").isin(*SAID)).select("case_id", "frame", "value")


def empty_cells(cells: DataFrame, cases: DataFrame, frames: DataFrame) -> DataFrame:
    """(case_id, frame) without a value: the few declared frames against all cases."""
    return cases.select("case_id").join(F.broadcast(frames.select("frame")), how="cross").join(cells, ["case_id", "frame"], "left_anti")


def wide(cells: DataFrame, dimensions: list[str], verdict: str) -> DataFrame:
    """One row per case with every dimension stated."""
    table = single(cells).groupBy("case_id").pivot("frame", [*dimensions, verdict]).agg(F.min("value"))
    return table.dropna(subset=dimensions)


def differing_in_one(cells: DataFrame, dimensions: list[str], verdict: str) -> DataFrame:
    """Method of difference: (a, b, dimension, verdict_a, verdict_b) of cases alike in all dimensions but one.

    Cases are not crossed: for each dimension they meet on the values of all the others, and the cases of one pattern are
    first gathered per value, so the pairs are those of the result."""
    table = wide(cells, dimensions, verdict)
    out = None
    for d in dimensions:
        others = [x for x in dimensions if x != d]
        key = [F.col(x) for x in others]
        left = table.select(*key, F.col("case_id").alias("a"), F.col(d).alias("da"), F.col(verdict).alias("verdict_a"))
        right = table.select(*key, F.col("case_id").alias("b"), F.col(d).alias("db"), F.col(verdict).alias("verdict_b"))
        pairs = left.join(right, others).filter("a < b AND da <> db").select("a", "b", F.lit(d).alias("dimension"), "verdict_a", "verdict_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def difference_counts(cells: DataFrame, dimensions: list[str], verdict: str) -> DataFrame:
    """(dimension, pairs, apart): how many pairs differing_in_one has for each dimension, and how many of them have two different verdicts.

    No pair is made: of the cases of one pattern of the other dimensions, the pairs with different values are all pairs less those of one value,
    and those that agree in the verdict are counted the same way, so cases are counted once and the rest is sums over patterns."""
    counted = materialised(wide(cells, dimensions, verdict).groupBy(*dimensions, verdict).agg(F.count("*").alias("n")))
    square = F.col("n").cast("decimal(38,0)") * F.col("n")
    out = None
    for d in dimensions:
        others = [x for x in dimensions if x != d]
        judged = counted.filter(F.col(verdict).isNotNull())

        def unlike(rows: DataFrame, key: list[str], d: str = d) -> DataFrame:
            """(pairs): the pairs of cases alike in the key with different values of d."""
            values = rows.groupBy(*key, d).agg(F.sum("n").alias("n"))
            alike = values.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(square).alias("same"))
            return alike.agg(F.sum(((square - F.col("same")) / 2).cast("bigint")).alias("pairs"))

        sums = unlike(counted, others).crossJoin(unlike(judged, others).withColumnRenamed("pairs", "judged")).crossJoin(unlike(judged, [*others, verdict]).withColumnRenamed("pairs", "agree"))  # a row each
        row = sums.select(F.lit(d).alias("dimension"), "pairs", (F.coalesce("judged", F.lit(0)) - F.coalesce("agree", F.lit(0))).alias("apart")).filter("pairs > 0")
        out = row if out is None else out.unionByName(row)
    return out


def patterns_apart(cells: DataFrame, dimensions: list[str], verdict: str) -> DataFrame:
    """Patterns of dimensions whose cases got different verdicts: alike in every stated dimension, judged apart."""
    table = wide(cells, dimensions, verdict).filter(F.col(verdict).isNotNull())
    return table.groupBy(*dimensions).agg(F.count_distinct(verdict).alias("verdicts"), F.count("*").alias("cases")).filter("verdicts > 1")


def against_rule(cells: DataFrame, when: dict[str, str], verdict: str, then: str) -> DataFrame:
    """(case_id, meets, got): cases that meet a rule and got another verdict, or got its verdict without meeting it."""
    table = wide(cells, list(when), verdict).filter(F.col(verdict).isNotNull())
    meets = None
    for k, v in when.items():
        meets = (F.col(k) == v) if meets is None else meets & (F.col(k) == v)
    rows = table.select("case_id", meets.alias("meets"), F.col(verdict).alias("got"))
    return rows.filter((F.col("meets") & (F.col("got") != then)) | (~F.col("meets") & (F.col("got") == then)))


def dominated(ranks: DataFrame, dimensions: list[str]) -> DataFrame:
    """case_id of the cases that another is no worse than in every ranked dimension and better in one (higher ranks are worse).

    Only distinct rank patterns are compared, so a table of many cases costs what its patterns cost."""
    pattern = ranks.dropna(subset=dimensions).select(*dimensions).distinct()
    a, b = pattern.alias("a"), pattern.alias("b")
    no_better, worse = F.lit(True), F.lit(False)
    for d in dimensions:
        no_better = no_better & (F.col(f"a.{d}") >= F.col(f"b.{d}"))
        worse = worse | (F.col(f"a.{d}") > F.col(f"b.{d}"))
    beaten = a.join(b, no_better & worse, "left_semi").select(*[F.col(f"a.{d}").alias(d) for d in dimensions])
    return ranks.join(beaten, dimensions, "left_semi").select("case_id")


def crosstab(cells: DataFrame, rows: str, columns: str) -> DataFrame:
    """(row_value, column_value, n): cases that have a value in both frames."""
    r = cells.filter(F.col("frame") == rows).select("case_id", F.col("value").alias("row_value"))
    c = cells.filter(F.col("frame") == columns).select("case_id", F.col("value").alias("column_value"))
    return r.join(c, "case_id").groupBy("row_value", "column_value").agg(F.count_distinct("case_id").alias("n"))


def conditions(cases: DataFrame, flags: list[str], outcome: str) -> DataFrame:
    """(mask, n, with_outcome, sufficient): for each combination of conditions, the cases and whether all have the outcome."""
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    n, hit = F.count("*"), F.sum(F.col(outcome).cast("int"))
    return cases.groupBy(mask.alias("mask")).agg(n.alias("n"), hit.alias("with_outcome")).withColumn("sufficient", F.col("n") == F.col("with_outcome"))


def minimal_sufficient(table: DataFrame) -> DataFrame:
    """Sufficient masks without a sufficient proper subset. At most 16 rows: four conditions."""
    good = table.filter("sufficient").select("mask")
    smaller = good.select(F.col("mask").alias("m"))
    return good.join(F.broadcast(smaller), F.expr("m <> mask AND (m & mask) = m"), "left_anti")


def bearing(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """(row_id, account, cell): for, against or both, of the reasons that bear on an account. edges: (src, dst, kind)."""
    reasons = edges.join(accounts.select(F.col("account").alias("dst")), "dst", "left_semi").join(accounts.select(F.col("account").alias("src")), "src", "left_anti")
    word = F.when(F.col("kind") == "support", "for").when(F.col("kind").isin("attack", "undercut", "contradictory", "contrary"), "against")
    cells = reasons.withColumn("v", word).filter("v IS NOT NULL").groupBy(F.col("src").alias("row_id"), F.col("dst").alias("account"))
    return cells.agg(F.when(F.count_distinct("v") > 1, "both").otherwise(F.min("v")).alias("cell"))


def rows_of(cells: DataFrame) -> DataFrame:
    """(row_id, kind): one (bears on one account), alike (the same on all it bears on) or apart."""
    n = F.count("*")
    alike = (F.count_distinct("cell") == 1) & (F.max("cell") != "both")
    return cells.groupBy("row_id").agg(F.when(n < 2, "one").when(alike, "alike").otherwise("apart").alias("kind"))
