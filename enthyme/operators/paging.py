"""Bands and pages of line-addressed texts: what a map leaves out of a text's own order, and whether pinpoints cite the page of the words.

A text is the table of its lines (source_id, line, raw). Its bands are the sections of the highest level that divides it, or its printed
pages. Defined results: a text without such headings or markers has no bands; null lines are blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words, pinned_pages
from ..plans.tables import materialised
from .lines import PAGE
from .places import MIN_VERBATIM, folded_lines, lowered_parts, occurring, shaped

# Headings of back matter, headings by which a text announces itself, headings that are a link.
BACK_MATTER = (
    r"(?i)^(references|bibliography|works cited|notes|footnotes|endnotes|funding|acknowledg|appendix|"
    r"conflicts? of interest|competing interests|author contributions|data availability|"
    r"declarations?|academic tools|other internet resources|related entries|"
    r"(the )?(full )?project gutenberg)"
)
ANNOUNCING = r"(?i)^(?:[\dIVX]+[.)]?\s*)?(abstract|introduction|summary|conclusions?|overview|preface|concluding remarks)\b"
LINK_ONLY = r"^\[[^\]]*\]\([^)]*\)$"
#: Words of prose that a section needs to divide a text, or to be missed.
MIN_BAND_WORDS = 50
HEADING = r"^(#{1,6})\s+(.*?)\s*(?:\{.*\})?\s*$"
BETWEEN = r"^\s*($|<!--.*-->)"
#: Least share of a claim's words in a paragraph that places it there, and characters of a paragraph.
MIN_SCORE, MIN_PARA = 0.3, 120


def in_text() -> Window:
    return Window.partitionBy("source_id").orderBy("line")


def zoned(lines: DataFrame) -> DataFrame:
    """Adds zone: front (between --- at the top), comment (<!-- to -->, over lines), abstract, or text."""
    t, w = F.trim("raw"), in_text()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("raw", F.coalesce("raw", F.lit("")))
    lines = lines.withColumn("fence", F.coalesce(F.sum(F.when(t.isin("---", "...") & (F.col("line") > 1), 1).otherwise(0)).over(before), F.lit(0))).withColumn("front", (F.first(t).over(whole) == "---"))
    lines = lines.withColumn("front", F.col("front") & (F.col("fence") == 0))
    mark = F.when(F.col("front"), None).when(F.contains(t, F.lit("-->")), "out").when(F.startswith(t, F.lit("<!--")), "in")
    lines = lines.withColumn("comment", ~F.col("front") & (F.startswith(t, F.lit("<!--")) | F.coalesce(F.last(mark, True).over(before) == "in", F.lit(False))))
    # an abstract runs from its heading to the next one of its level or above, or is a paragraph that opens with the label
    level = F.when(~F.col("front") & ~F.col("comment"), F.nullif(F.length(F.regexp_extract(t, HEADING, 1)), F.lit(0)))
    name = F.trim(F.regexp_replace(F.regexp_extract(t, HEADING, 2), "[*_]", ""))
    lines = lines.withColumn("level", level).withColumn("opens", F.when(level.isNotNull() & F.regexp_like(name, F.lit(r"(?i)^abstract[.:]?$")), F.col("level")))
    lines = lines.withColumn("under", F.last("opens", True).over(before)).withColumn("since", F.last(F.when(F.col("opens").isNotNull(), F.col("line")), True).over(before))
    closed = F.min(F.coalesce("level", F.lit(9))).over(Window.partitionBy("source_id", "since").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("under").isNotNull() & (closed > F.col("under"))
    label = F.regexp_like(t, F.lit(r"(?i)^[*_]*abstract[*_]*\s*[.:—-]"))
    zone = F.when(F.col("front"), "front").when(F.col("comment"), "comment").when(F.col("level").isNull() & (inside | label), "abstract").otherwise("text")
    return lines.withColumn("zone", zone).drop("fence", "front", "comment", "opens", "under", "since")


def worded(lines: DataFrame) -> DataFrame:
    """Zoned lines with words: those of prose, none in front matter, comments, fenced code and headings."""
    prose = F.col("zone").isin("text", "abstract")
    fence = prose & F.regexp_like("raw", F.lit(r"^\s*(```|~~~)"))
    inside = F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(in_text().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    count = F.size(F.regexp_extract_all("raw", F.lit(r"(\S*[A-Za-z0-9]\S*)"), 1))
    head = F.regexp_like(F.trim("raw"), F.lit(r"^#{1,6}\s"))
    return lines.withColumn("words", F.when(prose & ~fence & ~inside & ~head, count).otherwise(0))


def bands(lines: DataFrame) -> DataFrame:
    """(source_id, line, end, heading, back, page, words) of worded lines."""
    w = in_text()
    lines = lines.withColumn("total", F.sum("words").over(w)).withColumn("mark", F.nullif(F.regexp_extract("raw", PAGE, 1), F.lit("")).cast("int"))
    size = lines.groupBy("source_id").agg(F.max("line").alias("n_lines"), F.max("total").alias("all_words"))
    level = F.length(F.regexp_extract("raw", HEADING, 1))
    heads = lines.select("source_id", "line", "total", level.alias("level"), F.trim(F.regexp_extract("raw", HEADING, 2)).alias("heading")).filter("level > 0")
    following = w.rowsBetween(1, Window.unboundedFollowing)
    closes = F.coalesce(*(F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.struct("line", "total"))).over(following)) for k in range(1, 7)))
    heads = heads.withColumn("next", closes).join(size, "source_id")
    heads = heads.withColumn("under", F.coalesce(F.col("next.total"), F.col("all_words")) - F.col("total")).withColumn("link", F.regexp_like("heading", F.lit(LINK_ONLY))).withColumn("back", F.regexp_like("heading", F.lit(BACK_MATTER)))
    dividing = heads.filter(f"under >= {MIN_BAND_WORDS} AND NOT back AND NOT link").groupBy("source_id", "level").agg(F.count("*").alias("n")).filter("n > 1")
    chosen = dividing.groupBy("source_id").agg(F.min("level").alias("chosen"))
    sections = heads.join(chosen, "source_id").filter("level = chosen AND under > 0 AND NOT link").select("source_id", "line", "heading", "back", F.lit(False).alias("page"))
    marks = lines.filter("mark IS NOT NULL").join(chosen, "source_id", "left_anti")
    paged = marks.join(marks.groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1"), "source_id")
    paged = paged.select("source_id", "line", F.concat(F.lit("p. "), F.col("mark").cast("string")).alias("heading"), F.lit(False).alias("back"), F.lit(True).alias("page"))
    every = sections.unionByName(paged).withColumn("end", F.lead("line").over(w) - 1).join(size, "source_id").withColumn("end", F.coalesce("end", "n_lines"))
    # words from a band's line to its end: the running total at its end less the one before it
    at = lines.select("source_id", F.col("line").alias("end"), F.col("total").alias("to"))
    first = lines.select("source_id", "line", (F.col("total") - F.col("words")).alias("from"))
    return every.join(at, ["source_id", "end"]).join(first, ["source_id", "line"]).select("source_id", "line", "end", "heading", "back", "page", (F.col("to") - F.col("from")).alias("words"))


def exposition(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_id, kind, heading, line, end, words, mapped, first): for texts with a mark (source_id, line), the `body` and the `opening` before the first band with
    their words and marks, and each `gap`: a band, or a run of pages, without a mark that announces itself or where
    the text's own density of marks would have put two."""
    marks = marks.select("source_id", F.col("line").alias("at"))
    mapped = lines.join(marks.select("source_id").distinct(), "source_id", "left_semi")
    rows = materialised(worded(zoned(mapped)))
    bounds = materialised(bands(rows))
    hits = bounds.join(marks, (bounds["source_id"] == marks["source_id"]) & F.col("at").between(F.col("line"), F.col("end"))).groupBy(bounds["source_id"], "line").agg(F.count("*").alias("mapped"))
    held = bounds.join(hits, ["source_id", "line"], "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    body = held.filter("NOT back").groupBy("source_id").agg(F.sum("words").alias("body_words"), F.sum("mapped").alias("body_mapped"))
    start = bounds.groupBy("source_id").agg(F.min("line").alias("start"))
    opening = rows.join(start, "source_id").filter("line < start").groupBy("source_id").agg(F.sum("words").alias("words"))
    above = marks.join(start, "source_id").filter("at < start").groupBy("source_id").agg(F.count("*").alias("mapped"))
    opening = start.join(opening, "source_id", "left").join(above, "source_id", "left")
    # empty pages in a row are one gap; sections stand for themselves
    w = in_text()
    empty = (F.col("mapped") == 0) & ~F.col("back")
    held = held.withColumn("empty", empty).withColumn("joins", empty & F.col("page") & F.lag("empty", 1, False).over(w) & F.lag("page", 1, False).over(w))
    held = held.withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w)).filter("empty")
    runs = held.groupBy("source_id", "run").agg(
        F.min("line").alias("line"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("n"), F.min_by("heading", "line").alias("a"), F.max_by("heading", "line").alias("z")
    )
    heading = F.when(F.col("n") > 1, F.concat(F.lit("pp. "), F.replace("a", F.lit("p. "), F.lit("")), F.lit("-"), F.replace("z", F.lit("p. "), F.lit("")))).otherwise(F.col("a"))
    gaps = runs.withColumn("heading", heading).join(body, "source_id").filter(F.col("words") >= MIN_BAND_WORDS)
    gaps = gaps.filter(F.regexp_like("heading", F.lit(ANNOUNCING)) | (F.col("words") * F.col("body_mapped") >= 2 * F.col("body_words")))
    said = ~F.regexp_like(F.trim("raw"), F.lit(r"^($|#|<!--|\[\^)"))
    spoken = rows.filter(said).select("source_id", F.col("line").alias("at"), F.trim(F.regexp_replace(F.trim("raw"), r"^>\s*", "")).alias("t"))
    firsts = gaps.select("source_id", F.col("line").alias("low"), "end").join(spoken, "source_id").filter("at > low AND at <= end").groupBy("source_id", F.col("low").alias("line")).agg(F.min_by("t", "at").alias("t"))
    sentence = F.coalesce(F.nullif(F.regexp_extract("t", r"^(.+?[.?!])(?:\s|$)", 1), F.lit("")), F.col("t"))
    short = F.when(F.length(sentence) <= 150, sentence).otherwise(F.concat(F.rtrim(F.left(sentence, F.lit(147))), F.lit("...")))
    gaps = gaps.join(firsts, ["source_id", "line"], "left").select("source_id", F.lit("gap").alias("kind"), "heading", "line", "end", "words", F.lit(0).cast("long").alias("mapped"), F.coalesce(short, F.lit("")).alias("first"))
    none = lambda kind: F.lit(None).cast(kind)
    of = lambda df, kind, words, mapped: df.select("source_id", F.lit(kind).alias("kind"), none("string").alias("heading"), none("int").alias("line"), none("int").alias("end"), F.coalesce(words, F.lit(0)).alias("words"), F.coalesce(mapped, F.lit(0)).alias("mapped"), none("string").alias("first"))
    return gaps.unionByName(of(body, "body", F.col("body_words"), F.col("body_mapped"))).unionByName(of(opening, "opening", F.col("words"), F.col("mapped")))


def page_ranges(lines: DataFrame) -> DataFrame:
    """Adds page_lo and page_hi, the pages a line may be on: a paragraph with markers right above it may begin on the page before
    the first of them, one with markers right below it may run on to the last of them. Null above the first marker."""
    w = in_text()
    lines = lines.withColumn("mark", F.nullif(F.regexp_extract("raw", PAGE, 1), F.lit("")).cast("int")).withColumn("solid", ~F.regexp_like("raw", F.lit(BETWEEN)))
    lines = lines.withColumn("page", F.last("mark", True).over(w)).withColumn("stretch", F.sum(F.col("solid").cast("int")).over(w))
    # a stretch is a paragraph and what stands between it and the next one
    marks = lines.groupBy("source_id", "stretch").agg(F.min(F.when(~F.col("solid"), F.col("mark"))).alias("low"), F.max(F.when(~F.col("solid"), F.col("mark"))).alias("high"))
    marks = marks.withColumn("above", F.lag("low").over(Window.partitionBy("source_id").orderBy("stretch")))
    lines = lines.join(marks, ["source_id", "stretch"])
    # greatest and least skip nulls
    low = F.when(F.col("solid"), F.least("page", F.col("above") - 1)).otherwise(F.col("page"))
    high = F.when(F.col("solid"), F.greatest("page", "high")).otherwise(F.col("page"))
    return lines.withColumn("page_lo", F.when(F.col("page").isNotNull(), low)).withColumn("page_hi", F.when(F.col("page").isNotNull(), high)).drop("solid", "stretch", "low", "high", "above")


def on_page(pins: Column) -> Column:
    """Whether a line's pages hold one of the pins."""
    return F.coalesce(F.exists(pins, lambda p: p.between(F.col("page_lo"), F.col("page_hi"))), F.lit(False))


def resolved(claims: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, source_id, pinpoint, line, via): the best line for each claim (claim_id, source_id, text, quote, declared, section, pinpoint) in its own
    source (source_id, text). The first that there is: where its quotation stands; where its own words stand; the declared line; the paragraph of its section (or of
    the text) with most of its words; its section's heading. Of several lines one in the text goes first, then one on a pinned page, one outside an abstract,
    the earliest."""
    body = sources.select("source_id", shaped(F.col("text")).alias("body"))
    ranged = materialised(page_ranges(zoned(lines)))
    offsets = folded_lines(lines)
    asked = claims.select("claim_id", "source_id", "pinpoint", F.explode(F.array(F.struct(F.lit(1).alias("via"), F.col("quote").alias("q")), F.struct(F.lit(2).alias("via"), F.when(F.length("text") >= MIN_VERBATIM, F.col("text")).alias("q")))).alias("x"))
    asked = asked.select("claim_id", "source_id", "pinpoint", "x.via", lowered_parts(F.col("x.q")).alias("parts")).filter(F.size("parts") > 0)
    found = occurring(asked.join(body, "source_id")).select("claim_id", "source_id", "pinpoint", "via", F.col("spans")[0]["begin"].alias("at"))
    stands = found.join(offsets, "source_id").filter("begin <= at AND at < end").select("claim_id", "source_id", "pinpoint", "via", "line")
    pins = pinned_pages(F.col("pinpoint"))
    placed = stands.join(ranged.select("source_id", "line", "zone", "page_lo", "page_hi"), ["source_id", "line"])
    order = F.struct("via", F.col("zone").isin("front", "comment").alias("hidden"), ((F.size(pins) > 0) & ~on_page(pins)).alias("off"), (F.col("zone") == "abstract").alias("abstract"), "line")
    exact = placed.groupBy("claim_id").agg(F.min(order).alias("b")).select("claim_id", F.col("b.via").alias("exact_via"), F.col("b.line").alias("exact_line"))

    w = in_text()
    heads = lines.withColumn("level", F.length(F.regexp_extract("raw", HEADING, 1))).filter("level > 0").withColumn("heading", F.trim(F.regexp_extract("raw", HEADING, 2)))
    closes = F.coalesce(*(F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line"))).over(w.rowsBetween(1, Window.unboundedFollowing))) for k in range(1, 7)))
    spans = heads.withColumn("stop", closes).groupBy("source_id", F.col("heading").alias("section")).agg(F.min(F.struct("line", "stop")).alias("s"))
    sectioned = claims.join(spans, ["source_id", "section"], "left").select("claim_id", "source_id", "text", F.col("s.line").alias("top"), F.col("s.stop").alias("stop"))
    want = sectioned.filter("top IS NOT NULL").select("claim_id", "source_id", "top", "stop", F.size(content_words(F.col("text"))).alias("total"), F.explode(content_words(F.col("text"))).alias("word"))
    want = want.groupBy("claim_id", "source_id", "top", "stop", "total", "word").agg(F.count("*").alias("n"))
    para = lines.withColumn("p", F.trim("raw")).filter((F.length("p") >= MIN_PARA) & ~F.startswith("p", F.lit("#"))).select("source_id", "line", F.explode(F.array_distinct(content_words(F.col("p")))).alias("word"))
    scored = para.join(want, ["source_id", "word"]).filter("line >= top AND (stop IS NULL OR line < stop)").groupBy("claim_id", "line", "total").agg(F.sum("n").alias("hit"))
    best = scored.groupBy("claim_id").agg(F.min(F.struct((-F.col("hit") / F.col("total")).alias("m"), "line")).alias("b")).filter(-F.col("b.m") >= MIN_SCORE).select("claim_id", F.col("b.line").alias("para_line"))

    every = claims.join(exact, "claim_id", "left").join(best, "claim_id", "left").join(sectioned.select("claim_id", "top"), "claim_id", "left")
    names = F.when(F.col("exact_line").isNotNull(), F.when(F.col("exact_via") == 1, "quotation").otherwise("own words")).when(F.col("declared").isNotNull(), "declared").when(F.col("para_line").isNotNull(), "paragraph").when(F.col("top").isNotNull(), "section").otherwise("chapter-only")
    return every.select("claim_id", "source_id", "pinpoint", F.coalesce("exact_line", "declared", "para_line", "top").alias("line"), names.alias("via"))


NOTE_PIN = r"(?i)(\bnn?\.\s*\d|\bnotes?\s+\d|\bfn\.?\s*\d)"
NOTES_HEADING = r"(?i)^#{1,6}\s+(?:notes|footnotes|endnotes)\b"


def pinpoints(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, source_id, pinpoint, line, verdict, off): for claims placed by the author's words, whether a page that the pinpoint cites holds them. `ok`; `off` by so many
    pages; `unpaged` where no pinpoint on the source cites a page it carries. A pinpoint to a note passes under a heading of notes,
    and one to the first page passes above the first marker."""
    ranged = materialised(page_ranges(lines).withColumn("notes", F.coalesce(F.regexp_like(F.last(F.when(F.regexp_like("raw", F.lit(HEADING)), F.col("raw")), True).over(in_text()), F.lit(NOTES_HEADING)), F.lit(False))))
    carried = ranged.filter("mark IS NOT NULL").groupBy("source_id").agg(F.collect_set("mark").alias("carried"), F.min_by("mark", "line").alias("first_mark"))
    pinned = placed.filter(F.col("via").isin("quotation", "own words")).withColumn("pins", pinned_pages(F.col("pinpoint"))).filter(F.size("pins") > 0)
    rows = pinned.join(carried, "source_id").withColumn("paged", F.arrays_overlap("pins", "carried"))
    known = rows.groupBy("source_id").agg(F.bool_or("paged").alias("any_paged"))
    rows = rows.join(known, "source_id").filter("paged OR NOT any_paged").join(ranged.select("source_id", "line", "page_lo", "page_hi", "notes"), ["source_id", "line"])
    first = F.col("page_lo").isNull() & F.array_contains("pins", F.col("first_mark"))
    fine = on_page(F.col("pins")) | (F.regexp_like("pinpoint", F.lit(NOTE_PIN)) & F.col("notes")) | first
    low, high = F.array_min("pins"), F.array_max("pins")
    off = F.when(F.col("page_lo") > high, F.col("page_lo") - high).otherwise(F.col("page_hi") - low)
    verdict = F.when(~F.col("paged"), "unpaged").when(fine, "ok").otherwise("off")
    return rows.withColumn("verdict", verdict).select("claim_id", "source_id", "pinpoint", "line", "verdict", F.when(F.col("verdict") == "off", off).alias("off"))


def pinpoint_patterns(checked: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, checked, wrong, low, high, shift, at_shift, verdict) of each source with pages: `shifted` where one offset accounts for most of the wrong pinpoints, `scattered` where
    there are `least` wrong ones or more without it, `slips` where there are fewer, `fine` or `unpaged`."""
    offsets = checked.filter("verdict = 'off' AND off IS NOT NULL").groupBy("source_id", "off").agg(F.count("*").alias("n"))
    modes = offsets.groupBy("source_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.abs("off").alias("a"), "off")).alias("b"), F.min("off").alias("low"), F.max("off").alias("high"))
    counts = checked.groupBy("source_id").agg(F.count(F.when(F.col("verdict") != "unpaged", 1)).alias("checked"), F.count(F.when(F.col("verdict") == "off", 1)).alias("wrong"))
    rows = counts.join(modes, "source_id", "left").withColumn("shift", F.col("b.off")).withColumn("at_shift", -F.col("b.m"))
    verdict = F.when(F.col("checked") == 0, "unpaged").when(F.col("wrong") == 0, "fine").when(F.col("wrong") < least, "slips").when(F.col("at_shift") * 2 > F.col("wrong"), "shifted").otherwise("scattered")
    return rows.select("source_id", "checked", "wrong", "low", "high", "shift", "at_shift", verdict.alias("verdict"))
