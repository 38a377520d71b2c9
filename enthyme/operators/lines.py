"""Line-addressed texts: zones, pages, sections, bands, runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, is_apparatus, word_count

PAGE = r"<!--\s*(?:[^\n]*?\s)?p\.\s*(\d+)\s+begins here\s*-->"


def source_lines(sources: DataFrame, s: str = "doc_id", text: str = "text") -> DataFrame:
    """(source_id, line, raw), lines from 1."""
    return sources.select(F.col(s).alias("source_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p", "raw")).select("source_id", (F.col("p") + 1).alias("line"), "raw")


def in_text() -> Window:
    return Window.partitionBy("source_id").orderBy("line")


def zones(lines: DataFrame) -> DataFrame:
    """Adds zone: front (between --- at the top), comment (<!-- to -->), heading, blank or prose."""
    t = F.trim("raw")
    w = in_text()
    lines = lines.withColumn("fence", F.sum(F.when(t.isin("---", "..."), 1).otherwise(0)).over(w)).withColumn("opens", F.first(t).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "---")
    front = F.col("opens") & ((F.col("fence") == 1) | (F.col("fence") == 2) & t.isin("---", "..."))
    mark = F.when(F.contains(t, F.lit("-->")), "out").when(F.startswith(t, F.lit("<!--")), "in")
    inside = (F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "in") | F.startswith(t, F.lit("<!--"))
    zone = F.when(front, "front").when(F.coalesce(inside, F.lit(False)), "comment").when(F.startswith(t, F.lit("#")), "heading").when(t == "", "blank").otherwise("prose")
    return lines.withColumn("zone", zone).drop("fence", "opens")


def pages(lines: DataFrame) -> DataFrame:
    """Adds page: that of the last page marker at or above the line; null above the first."""
    number = F.nullif(F.regexp_extract("raw", PAGE, 1), F.lit("")).cast("int")
    return lines.withColumn("page", F.last(number, True).over(in_text()))


def headings(lines: DataFrame) -> DataFrame:
    """(source_id, line, level, heading, end): a section ends before the next heading of its level or a higher one."""
    h = lines.filter(F.regexp_like("raw", F.lit("^#{1,6} "))).select("source_id", "line", F.length(F.regexp_extract("raw", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("raw", "^#+", "")).alias("heading"))
    last = lines.groupBy("source_id").agg(F.max("line").alias("total"))
    w = in_text().rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("level", "line")).over(w)
    nearest = F.array_min(F.transform(F.filter(later, lambda x: x["level"] <= F.col("level")), lambda x: x["line"]))
    return h.withColumn("next", nearest).join(last, "source_id").select("source_id", "line", "level", "heading", F.coalesce(F.col("next") - 1, "total").alias("end"))


def runs(lines: DataFrame, kind: Column) -> DataFrame:
    """(source_id, kind, first, last, n): islands of consecutive lines of one kind."""
    lines = lines.withColumn("kind", kind)
    island = F.col("line") - F.row_number().over(Window.partitionBy("source_id", "kind").orderBy("line"))
    return lines.withColumn("island", island).groupBy("source_id", "kind", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).drop("island")


def blanked(lines: DataFrame) -> DataFrame:
    """Lines of a publisher's apparatus emptied; the number of lines stays, so positions hold."""
    gone = is_apparatus(F.col("raw"))
    return lines.withColumn("blanked", gone).withColumn("raw", F.when(gone, "").otherwise(F.col("raw")))


def prose_words(lines: DataFrame) -> DataFrame:
    """(source_id, words): words of prose lines."""
    return lines.groupBy("source_id").agg(F.sum(F.when(F.col("zone") == "prose", word_count(F.col("raw"))).otherwise(0)).alias("words"))


def soup(text: Column) -> Column:
    """How unlike prose a text is, 0 to 1: the share of words that are no plain words with a little punctuation."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")), " "), lambda w: w != "")
    odd = F.filter(words, lambda w: ~F.regexp_like(w, F.lit("^[\"'(]?[\\p{L}][\\p{L}'-]*[\"').,;:!?]*$")))
    return F.when(F.size(words) > 0, F.size(odd) / F.size(words)).otherwise(0.0)
