"""Every check of a map against its texts finds its planted fault, and a clean map has none."""

from enthyme.operators import provenance_checks
from enthyme.operators.lines import source_lines

FILLER = " ".join(f"word{i}" for i in range(70))
FAULTY = f"""{FILLER} {FILLER}

## Introduction
Some bodies fall at the same rate, whereas others do not. {FILLER}

## Body
<!-- p. 3 begins here -->

A first passage of the source that is long enough to count as a run of its own in it. {FILLER} And a second passage, far from the first one, which counts as a run of its own as well.

More of the body stands here. {FILLER} The last sentence stands on a page of its own.

More here.
<!-- p. 9 begins here -->

The end.
"""
CLEAN = "## Introduction\n" + FILLER + "\n\n## Body\n<!-- p. 1 begins here -->\n\nThe claim is made here in so many words. " + FILLER + "\n"
CLAIM = "claim_id string, source_id long, text string, quote string, declared int, section string, pinpoint string"


def test_every_check_finds_its_fault(spark):
    splice = "A first passage of the source that is long enough to count as a run of its own And a second passage, far from the first one, which counts as a run of its own"
    rows = [
        ("lost", 1, "x", "words that are nowhere in it", None, None, None),
        ("cut", 1, "x", "bodies fall at the same rate", None, None, None),
        ("wide", 1, "x", "A first passage of the source ... far from the first one", None, None, None),
        ("splice", 1, splice, None, None, None, None),
        ("page", 1, "x", "The last sentence stands on a page of its own", None, None, "p. 9"),
        ("fine", 1, "x", "More of the body stands here", None, None, "p. 3"),
        ("nowhere", 1, "nothing alike", None, None, None, None),
        ("a", 2, "x", "The claim is made here in so many words", None, None, "p. 1"),
        ("b", 2, "x", None, 2, None, None),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    sources = spark.createDataFrame([(1, FAULTY), (2, CLEAN), (3, None)], "source_id long, text string")
    found = provenance_checks.provenance_findings(claims, sources, source_lines(sources, "source_id"))
    got = sorted((r.check, r.severity, r.title or "", r.message) for r in found.collect() if r.source_id == 1)
    assert [g[:3] for g in got] == [
        ("exposition-opening", "?", ""),
        ("pinpoint", "?", "page"),
        ("provenance-coverage", "?", ""),
        ("quotation", "!", "lost"),
        ("quotation-context", "?", "cut"),
        ("quotation-context", "?", "cut"),
        ("quotation-context", "?", "wide"),
        ("splice", "?", "splice"),
    ]
    messages = {g[0] + g[2]: g[3] for g in got}
    assert messages["pinpointpage"].startswith("cites p. 9, off by -6") and messages["provenance-coverage"].startswith("3 claims")
    assert {g[3].split()[0] for g in got if g[2] == "cut"} == {"drops", "stops"} and "passes over" in messages["quotation-contextwide"]
    assert [r for r in found.collect() if r.source_id in (2, 3)] == []
    assert provenance_checks.provenance_findings(claims.limit(0), sources, source_lines(sources, "source_id")).collect() == []
