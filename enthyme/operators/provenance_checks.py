"""The check of a map against its texts, end to end: where quotations stand, what they were cut from, what is spliced, what pinpoints cite, what the
text's own order leaves out. Every check is a query for the rows that break it, and all of them are one table.

(source_id, check, severity, title, message): `!` is a fault, `?` is something to look at; a finding about a text has no title. Claims are (claim_id, source_id, text,
quote, declared, section, pinpoint), sources (source_id, text); each claim is held against its own source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_parts
from ..plans.tables import materialised
from . import paging, places, splices

#: Words before the first band from which an opening with at most one claim is thin; wrong pinpoints that make a pattern.
OPENING_WORDS, PATTERN = 100, 3


def finding(rows: DataFrame, check: str, severity: str, title: Column, message: Column) -> DataFrame:
    return rows.select("source_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), title.cast("string").alias("title"), message.alias("message"))


def no_title() -> Column:
    return F.lit(None).cast("string")


def quotation_faults(claims: DataFrame, placed: DataFrame) -> DataFrame:
    """Quotations that are not in the source they are given for."""
    asked = claims.filter(F.size(quote_parts(F.col("quote"))) > 0).select("claim_id", "quote")
    lost = placed.filter("via <> 'quotation'").join(asked, "claim_id")
    return finding(lost, "quotation", "!", F.col("claim_id"), F.col("quote"))


def contexts(claims: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """Hedges dropped before a quotation, corrections cut off behind it, wide elisions."""
    body = sources.select("source_id", places.shaped(F.col("text")).alias("body"))
    asked = claims.select(F.col("claim_id").alias("quote_id"), "source_id", places.lowered_parts(F.col("quote")).alias("parts")).filter(F.size("parts") > 0)
    found = materialised(places.occurring(asked.join(body, "source_id")).select("quote_id", "source_id", "nth", "spans", "body"))
    rows = places.quotation_context(found, lines)
    said = F.array_compact(
        F.array(
            F.when(F.col("dropped").isNotNull(), F.concat(F.lit("drops "), "dropped")),
            F.when(F.col("continues").isNotNull(), F.concat(F.lit("stops before "), "continues")),
            F.when(F.col("gap") > 0, F.concat(F.lit("passes over "), F.col("gap").cast("string"), F.lit(" characters"))),
        )
    )
    return finding(rows.select("source_id", "quote_id", F.explode(said).alias("said")), "quotation-context", "?", F.col("quote_id"), F.col("said"))


def spliced(claims: DataFrame, sources: DataFrame) -> DataFrame:
    rows = splices.spliced(claims.withColumn("note", F.lit(None).cast("string")), sources).join(claims.select("claim_id", "source_id"), "claim_id")
    return finding(rows, "splice", "?", F.col("claim_id"), F.concat(F.lit("..."), "left", F.lit(" | "), "right", F.lit("...")))


def pinned(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """Pinpoints off the page of the words; once for a text where they are a pattern, and where its pages are not the ones cited."""
    checked = materialised(paging.pinpoints(placed, lines))
    off = checked.filter("verdict = 'off'")
    each = finding(off, "pinpoint", "?", F.col("claim_id"), F.concat(F.lit("cites "), "pinpoint", F.lit(", off by "), F.coalesce(F.col("off").cast("string"), F.lit("?")), F.lit(", line "), F.col("line").cast("string")))
    patterns = paging.pinpoint_patterns(checked)
    shifted = patterns.filter(F.col("wrong") >= PATTERN)
    several = finding(shifted, "pinpoint", "?", no_title(), F.concat(F.col("wrong").cast("string"), F.lit(" off by "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string")))
    unpaged = finding(patterns.filter("verdict = 'unpaged'"), "pinpoint-pages", "?", no_title(), F.lit("no pinpoint cites a page that the text carries"))
    return each.unionByName(several).unionByName(unpaged)


def exposed(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """The sections in which a text announces itself, where nothing is mapped; a thin opening; claims without a place."""
    rows = materialised(paging.exposition(lines, placed.filter("line IS NOT NULL")))
    named = F.concat(F.left("heading", F.lit(40)), F.lit(" ("), F.col("words").cast("string"), F.lit(" words)"))
    gaps = rows.filter((F.col("kind") == "gap") & F.regexp_like("heading", F.lit(paging.ANNOUNCING))).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line", named.alias("named")))).alias("g"))
    gaps = finding(gaps, "exposition-gap", "?", no_title(), F.array_join(F.transform("g", lambda x: x["named"]), "; "))
    mapped = rows.filter("kind = 'body' AND mapped > 0").select("source_id")
    thin = rows.filter(f"kind = 'opening' AND words >= {OPENING_WORDS} AND mapped <= 1").join(mapped, "source_id", "left_semi")
    thin = finding(thin, "exposition-opening", "?", no_title(), F.concat(F.col("words").cast("string"), F.lit(" words before the first section")))
    lost = placed.filter("line IS NULL").groupBy("source_id").agg(F.count("*").alias("n"))
    return gaps.unionByName(thin).unionByName(finding(lost, "provenance-coverage", "?", no_title(), F.concat(F.col("n").cast("string"), F.lit(" claims without a place"))))


def provenance_findings(claims: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    placed = materialised(paging.resolved(claims, sources, lines))
    parts = (quotation_faults(claims, placed), contexts(claims, sources, lines), spliced(claims, sources), pinned(placed, lines), exposed(placed, lines))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
