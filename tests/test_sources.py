import json

from pyspark.sql import functions as F

from enthyme.sources import files, maps

MAP = """===
title: "A planted map"
mechanism:
    levels: [macro, micro]
    states:
        a: {label: "First, of all", role: condition}
===
# Section one
[Main]: The conclusion
holds. #thesis
    {fidelity: quotation, about: {case: one}}

<Linked>: Two together.

(1) [P1]: First. // a comment
(2) [P2]: Second.
-- Modus ponens --
(3) [Mid]: Between.
(4) [P3]: Third.
----
(5) [Main]

[Obj]: Against.
    -> [P1]
    <- [Reply]: Back.
        +> [P2]
[Under]: No.
    _> <Linked>
[Rival]: Not so.
    >< [P3]
[Bad]: x
    {a: 1, a: 2}
"""


def test_map_notation(spark):
    parsed = maps.rows(spark.createDataFrame([("m", MAP), ("e", None)], "path string, text string")).cache()
    front = json.loads(parsed.filter("kind = 'front'").first().body)
    assert front["title"] == "A planted map" and front["mechanism"]["states"]["a"] == {"label": "First, of all", "role": "condition"}
    c = {r.title: r for r in maps.claims(parsed).collect()}
    assert c["Main"].text == "The conclusion holds." and c["Main"].tags == ["thesis"] and c["Main"].section == "Section one" and c["P1"].text == "First."
    assert {(r.src, r.dst, r.type) for r in maps.relations(parsed).collect()} == {("Obj", "P1", "attack"), ("Reply", "Obj", "attack"), ("Reply", "P2", "support"), ("Under", "Linked", "undercut"), ("Rival", "P3", "contradictory")}
    p = {r.n: (r.role, r.title, r.rule) for r in maps.pcs_lines(parsed).collect()}
    assert p == {1: ("premise", "P1", None), 2: ("premise", "P2", None), 3: ("intermediary-conclusion", "Mid", "Modus ponens"), 4: ("premise", "P3", None), 5: ("main-conclusion", "Main", None)}
    e = {(r.src, r.dst, r.kind) for r in maps.title_edges(parsed).collect()}
    assert {("P1", "Mid", "support"), ("P2", "Mid", "support"), ("Mid", "Main", "support"), ("P3", "Main", "support"), ("Under", "Main", "undercut")} <= e and ("P1", "Main", "support") not in e
    assert [r.message for r in maps.faults(parsed).collect()] == ["`a` is given twice"]


def test_bundles(spark):
    m = spark.createDataFrame([("m", "[A]: b\n")], "map_id string, text string")
    s = spark.createDataFrame([("m", "two.md", 2, "second\n%% x"), ("m", "one.md", 1, "first é")], "map_id string, name string, ord int, text string")
    once = files.attach(m, s)
    again = files.attach(once.withColumnRenamed("bundle", "text"), s)
    assert once.collect() == again.collect()
    assert [(r.name, r.text, r.whole) for r in files.detach(again).collect()] == [(None, "[A]: b\n", True), ("one.md", "first é", True), ("two.md", "second\n%% x", True)]
    assert [r.whole for r in files.detach(again.withColumn("bundle", F.expr("left(bundle, length(bundle) - 3)"))).collect()] == [True, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("before\n# One\ntext\n# Two\nmore")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PDF").write_bytes(b"x")
    (tmp_path / "c.xyz").write_bytes(b"y")
    got = {r.path.rsplit("/", 1)[-1]: (r.tier, r.skipped) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("gold", False), "b.PDF": ("bronze", False), "c.xyz": (None, True)}
    parts = files.chapters(files.texts(spark, str(tmp_path))).orderBy("chapter").collect()
    assert [(r.chapter, r.title, r.text) for r in parts] == [(0, None, "before"), (1, "One", "# One\ntext"), (2, "Two", "# Two\nmore")]
    xml = "<TEI><text><body><div><head>H</head><p>a <hi>b</hi></p><div><head>I</head><p>c<note>n</note></p></div></div></body></text></TEI>"
    rows = files.marked_up(spark.createDataFrame([("x", xml), ("y", "<a>")], "path string, text string")).collect()
    assert [(r.kind, r.text) for r in rows if r.path == "x"] == [("h1", "H"), ("p", "a b"), ("h2", "I"), ("p", "cn")] and [r.kind for r in rows if r.path == "y"] == ["fault"]
