"""Places of quotations, contexts, bands and pages on planted texts."""

import re

from enthyme.operators import paging, places
from enthyme.operators.lines import source_lines

TREATISE = """---
title: Notes. Of a treatise
---
# Treatise

## Introduction

Some rivers freeze in the winter, whereas some rivers run the whole year round. A second sentence — “quoted” here… and on.

## Method
We hold, perhaps, that the *method* is
sound and complete, or more exactly that it is sound. {filler}

The last paragraph says it plainly! It ends well.
""".format(filler=" ".join(f"word{i}" for i in range(60)))


def sources(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, line string")


def quotes(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def found_in(spark, texts, asked):
    docs = sources(spark, *texts)
    found = places.occurrences(quotes(spark, *asked), docs)
    lines = source_lines(docs)
    return found, lines


def test_lines_of_quotations(spark):
    asked = ["the method is sound and complete", 'a second sentence - "quoted" here...', "Some rivers ... the whole year", "METHOD", "no such passage anywhere", "...", None]
    found, lines = found_in(spark, [TREATISE, None, "", TREATISE.replace("\n", " ")], asked)
    got = {(r.quote_id, r.source_id, r.nth): (r.first_line, r.last_line) for r in places.lines_held(found, lines).collect()}
    assert {k: v for k, v in got.items() if k[1] == 0} == {(0, 0, 1): (11, 12), (1, 0, 1): (8, 8), (2, 0, 1): (8, 8), (2, 0, 2): (8, 8)}
    assert {k[0] for k in got if k[1] == 3} == {0, 1, 2} and not {k for k in got if k[1] in (1, 2)}
    short, short_lines = places.occurrences(quotes(spark, "two words"), sources(spark, "Two\nwords. And two words again.", "one word"), least=4), source_lines(sources(spark, "Two\nwords. And two words again.", "one word"))
    assert sorted((r.nth, r.first_line, r.last_line) for r in places.lines_held(short, short_lines).collect()) == [(1, 1, 2), (2, 2, 2)]


def test_offsets_are_those_of_the_folded_text(spark):
    texts = [TREATISE, "a\n\n  b  \n*\n— c…\n\tİd", " \n "]
    docs = sources(spark, *texts)
    bodies = {r.doc_id: r.b for r in docs.select("doc_id", places.shaped(docs.text).alias("b")).collect()}
    raw = source_lines(docs)
    lines = {(r.source_id, r.line): r.t for r in raw.select("source_id", "line", places.shaped(raw.raw).alias("t")).collect()}
    for r in places.folded_lines(source_lines(docs)).collect():
        assert bodies[r.source_id][r.begin - 1 : r.end - 1] == lines[r.source_id, r.line] != ""


def test_what_a_quotation_was_cut_from(spark):
    asked = ["rivers freeze in the winter", "the method is sound and complete", "the last paragraph says it plainly!", "rivers freeze in the winter ... it ends well", "We hold, perhaps"]
    got = {r.quote_id: r for r in places.quotation_context(*found_in(spark, [TREATISE], asked)).collect()}
    assert got[0].dropped == "some" and got[0].continues.startswith("whereas some rivers") and not got[0].complete and got[0].sentence_last is None
    assert got[0].sentence.startswith("Some rivers") and got[0].sentence.endswith("year round.") and got[0].after.startswith("A second")
    assert got[1].continues.startswith("or more exactly") and got[1].dropped is None and got[1].sentence.startswith("We hold")  # the heading is another block
    assert got[2].complete and got[2].continues is None and got[2].after == "It ends well."
    assert got[3].gap > 200 and got[3].sentence_last == "It ends well." and got[3].after == ""
    assert got[4].dropped is None and got[4].continues is None


def test_terms_that_a_source_has_in_no_form(spark):
    claims = spark.createDataFrame([(1, 0, "#tag Mixing theories conserved whether treatises alone"), (2, 0, None), (3, 9, "absent")], "item_id long, doc_id long, text string")
    docs = sources(spark, "It mixes what a theory conserves.")
    got = {r.claim_id: r.terms for r in places.absent_terms(claims, docs).collect()}
    assert got == {1: "treatises,theories,alone", 2: ""}  # an ending goes, a stem is not made up


BOOK = "\n".join(
    ["---", "abstract: none", "---", "# Book", "## Abstract", "what it says " * 20, "<!-- a", "comment -->", "## One", "one two three " * 20, "```", "code words", "more code", "```"]
    + ["### Part", "four five " * 30, "## Empty", "## References", "six seven " * 40, "## [link](x)", "## Conclusion {#c}", "The end. " * 30]
)


def test_bands_and_gaps(spark):
    lines = source_lines(sources(spark, BOOK, "## only\n" + "w " * 80, None, ""))
    zones = {r.line: r.zone for r in paging.zoned(lines).filter("source_id = 0").collect()}
    assert [zones[k] for k in (1, 2, 3, 4, 6, 7, 8, 10)] == ["front", "front", "front", "text", "abstract", "comment", "comment", "text"]
    got = sorted((r.line, r.end, r.heading, r.back, r.words) for r in paging.bands(paging.worded(paging.zoned(lines))).filter("source_id = 0").collect())
    assert got == [(5, 8, "Abstract", False, 60), (9, 17, "One", False, 120), (18, 20, "References", True, 80), (21, 22, "Conclusion", False, 60)]
    marks = spark.createDataFrame([(0, 10), (0, 10), (0, 16), (0, 2)], "source_id long, line int")
    rows = sorted(((r.kind, r.heading or "", r.words, r.mapped, r.first or "") for r in paging.exposition(lines, marks).collect()))
    assert rows == [("body", "", 240, 3, ""), ("gap", "Abstract", 60, 0, ("what it says " * 20)[:147].rstrip() + "..."), ("gap", "Conclusion", 60, 0, "The end."), ("opening", "", 0, 1, "")]


def brute_ranges(raws):
    """The definition, line by line."""
    mark = lambda x: int(m[1]) if (m := re.search(r"p\.\s*(\d+) begins here", x)) else None
    between = lambda x: not x.strip() or (x.strip().startswith("<!--") and "-->" in x)
    page, out = None, []
    for i, raw in enumerate(raws):
        page = mark(raw) or page
        lo = hi = page
        if page is not None and not between(raw):
            j = i - 1
            while j >= 0 and between(raws[j]):
                lo = min(lo, mark(raws[j]) - 1) if mark(raws[j]) else lo
                j -= 1
            j = i + 1
            while j < len(raws) and between(raws[j]):
                hi = max(hi, mark(raws[j])) if mark(raws[j]) else hi
                j += 1
        out.append((lo, hi))
    return out


def test_pages_of_lines(spark):
    m = "<!-- p.{} begins here -->".format
    text = "\n".join(["above", m(3), "", "three", "", m(4), "<!-- note -->", m(5), "", "five", "more", m(6), "six", m(7)])
    rows = sorted((r.line, r.page_lo, r.page_hi) for r in paging.page_ranges(source_lines(sources(spark, text))).collect())
    assert [r[1:] for r in rows] == brute_ranges(text.split("\n"))


def test_claims_are_placed_by_the_first_way_that_holds(spark):
    m = "<!-- p.{} begins here -->".format
    text = "\n".join(["## Abstract", "The thesis is that clocks are slow.", m(1), "## One", "x", "The thesis is that clocks are slow.", m(2), "", "A longer paragraph about pendulum clocks and their periods, which depend on length and gravity and on very little else, as experiments showed long ago."])
    docs = sources(spark, text).selectExpr("doc_id AS source_id", "text")
    rows = [("q", "whatever", "the thesis is that clocks are slow", None, None, None), ("own", "The thesis is that clocks are slow.", None, None, None, "p. 1"), ("declared", "x", None, 5, "One", None), ("para", "pendulum periods depend on gravity", None, None, "One", None), ("section", "nothing alike", None, None, "One", None), ("none", "nothing alike", None, None, "Two", None), ("absent", "x", "not there at all", None, "One", None)]
    claims = spark.createDataFrame([(c, 0, t, q, d, s, p) for c, t, q, d, s, p in rows], "claim_id string, source_id long, text string, quote string, declared int, section string, pinpoint string")
    lines = source_lines(docs, "source_id")
    placed = paging.resolved(claims, docs, lines)
    got = {r.claim_id: (r.line, r.via) for r in placed.collect()}
    assert got == {"q": (6, "quotation"), "own": (6, "own words"), "declared": (5, "declared"), "para": (9, "paragraph"), "section": (4, "section"), "none": (None, "chapter-only"), "absent": (4, "section")}
    assert [(r.claim_id, r.verdict) for r in paging.pinpoints(placed, lines).collect()] == [("own", "ok")]


def test_a_constant_shift_is_told_from_slips(spark):
    m = "<!-- p.{} begins here -->".format
    sentence = lambda k: f"Sentence number {'abcdefgh'[k]} stands on a page of its own in this book."
    text = "\n".join(x for k in range(8) for x in (m(10 + k), "", sentence(k), "solid", ""))
    docs = sources(spark, text, text, text).selectExpr("doc_id AS source_id", "text")
    shift = {0: lambda k: 12 + k, 1: lambda k: 10 + (13, 0, 1, 2, 7, 4, 5, 6)[k] if k in (0, 4) else 10 + k, 2: lambda k: 500 + k}
    rows = [(f"{s}-{k}", s, sentence(k), f"p. {shift[s](k)}") for s in range(3) for k in range(8)]
    claims = spark.createDataFrame([(c, s, t, None, None, None, p) for c, s, t, p in rows], "claim_id string, source_id long, text string, quote string, declared int, section string, pinpoint string")
    lines = source_lines(docs, "source_id")
    checked = paging.pinpoints(paging.resolved(claims, docs, lines), lines)
    got = {r.source_id: (r.verdict, r.shift, r.checked) for r in paging.pinpoint_patterns(checked).collect()}
    assert got[0][0] == "shifted" and got[0][1] == -2 and got[1][0] == "slips" and got[2] == ("unpaged", None, 0)
