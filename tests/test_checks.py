from pyspark.sql import functions as F

from enthyme.functions import cleaning
from enthyme.functions.text import stamp
from enthyme.operators import checks, lines
from enthyme.sources import maps

MAP = """
[Main]: It holds.
<Good>: A step.

(1) [P]: If p then q.
    {formalization: "p -> q", formalized: "%s"}
(2) [Q]: p.
    {formalization: "p", formalized: "00000000"}
-- Modus ponens --
(3) [Main]
    {formalization: "q"}

<Wrong>: Affirms the consequent.

(1) [P]
(2) [Main]
-- Modus ponens --
(3) [Q]

<Thin>: One line.

(1) [Q]
----
(2) [R]: So r.
    {fidelity: guessed}

[Alone]: Nothing to do with it.
    {fidelity: imputed}
[Under]: No.
    _> [Main]
[A]: a
    +> [B]: b
        +> [A]
[Bad]: x
    {a: [1}
"""


def test_findings(spark):
    said = spark.range(1).select(stamp(F.lit("If p then q."))).first()[0]
    parsed = maps.rows(spark.createDataFrame([("m", MAP % said), ("ok", "[X]: x\n    +> [Y]: y\n")], "path string, text string")).cache()
    found = checks.findings(parsed).cache()
    got = {(r.check, r.message.split(":")[0]) for r in found.filter("map_id = 'm'").collect()}
    assert {("disconnected", "Alone"), ("statement-undercut", "Under > Main"), ("thin-step", "Thin"), ("inert", "A"), ("inert", "B"), ("stale-formalization", "Q"), ("invalid-step", "Wrong"), ("fidelity", "R"), ("warrant", "Alone")} <= got
    assert ("stale-formalization", "P") not in got and ("invalid-step", "Good") not in got and any(c == "parse" for c, _ in got)
    assert found.filter("map_id = 'ok'").isEmpty()
    row = checks.census(found).filter("map_id = 'm'").first()
    assert row.faults == sum(1 for r in found.filter("severity = '!'").collect()) and row.checks["inert"] == 2


def test_cleaning(spark):
    t = F.col("t")
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c).first()[0]
    assert one(cleaning.cleaned(t), "a\nDownloaded from x.org by Me on 1 May 2020\nﬁnd\x00 it") == "a\n\nfind it"
    assert one(cleaning.cleaned(t), "x *** START OF THE PROJECT GUTENBERG EBOOK A ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK A *** y") == "body"
    assert one(cleaning.cleaned(t), "# **Bold head**\n![a](data:image/png;base64,AAAA)") == "# Bold head\n![a](data:,removed)"
    assert one(cleaning.rejoined(t), "con-\ntrolled text\nwell-\nKnown") == "controlled\n text\nwell-\nKnown" and one(cleaning.cleaned(t), None) == ""
    assert one(cleaning.slug(t), "  What's New? In_it! ") == "whats-new-in-it" and one(cleaning.slug(t), "?") == "source"
    assert one(cleaning.quality(t), "good words b c d here") == 6 - 60 and one(cleaning.quality(t), None) == 0
    far = lines.source_lines(spark.createDataFrame([(1, "see Table 2" + "\n" * 60 + "| a |\nTable 3")], "doc_id int, text string"))
    assert [(r.label, r.line) for r in cleaning.lost_tables(far).collect()] == [("2", 1)]
