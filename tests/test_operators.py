import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from enthyme.functions import similar
from enthyme.functions import text as tx
from enthyme.operators import frames, graph, lines, mechanism, quotes, suppose


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.folded(t), t=" “A*b*” — <!-- p. 3 begins here -->\n C… ") == '"ab" - c...'
    assert one(spark, tx.quote_parts(t), t="First part ... no ... and the second ...") == ["First part", "and the second"]
    assert one(spark, tx.content_words(t), t="Those who would argue, ARGUE well") == ["argue", "argue", "well"][:0] + ["those", "argue", "argue", "well"]
    assert one(spark, tx.pinned_pages(t), t="see pp. 30, 33-35") == [30, 33, 34, 35] and one(spark, tx.pinned_pages(t), t="ch. 2") == []
    assert one(spark, tx.fnv1a(t), t="") == "811c9dc5" and one(spark, tx.fnv1a(t), t="a") != one(spark, tx.fnv1a(t), t="b")
    assert one(spark, tx.stamp(t), t=" The  CLAIM\n") == one(spark, tx.stamp(t), t="the claim")
    assert one(spark, tx.verbatim(t, F.lit("x")), t="too short to tell") is None


def test_quotations_in_order_and_near(spark):
    found = spark.createDataFrame([("we hold ... it fails", "We hold this. In the end it fails."), ("it fails ... we hold", "We hold this. In the end it fails.")], ["q", "s"])
    assert [r[0] for r in found.select(quotes.parts_in_order(F.col("q"), F.col("s"))).collect()] == [True, False]
    ratio, at = similar.nearest("the price of everything is wrong", "they say that the prices of everything are wrong, always")
    assert ratio >= 0.75 and at > 0 and similar.nearest("zzzzz", "abc")[0] == 0


def edited(rng, text, kind, rate):
    out = []
    for k, c in enumerate(text):
        hit = rng.random() < rate if kind != "even" else k % round(1 / rate) == 0
        if hit and kind == "delete":
            continue
        out.append(rng.choice("abcdefghijklmnop") if hit and kind in ("change", "even") else c)
        if hit and kind == "insert":
            out.append(rng.choice("abcdefghijklmnop"))
    return "".join(out)


def test_recall_of_near_matches_by_edits_and_length():
    """Of stretches that are alike by LEAST or more, how many are found: by kind and rate of edits, and length."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choices("aabcdeeefghiijklmnoopqrsttuvw", k=rng.randrange(2, 9))) for _ in range(n))
    recall = {}
    for words in (8, 20, 45):
        for kind, rate in [("change", 0.05), ("change", 0.12), ("change", 0.2), ("even", 0.1), ("insert", 0.1), ("delete", 0.1), ("delete", 0.18)]:
            hits = total = 0
            for _ in range(40):
                quote = say(words)
                changed = edited(rng, quote, kind, rate)
                before = say(rng.randrange(0, 200)) + " "
                text = f"{before}{changed} {say(rng.randrange(0, 200))}"
                there = max(SequenceMatcher(None, text[len(before) + d : len(before) + d + len(quote)], quote, autojunk=False).ratio() for d in (-4, -2, 0, 2, 4) if len(before) + d >= 0)
                if there >= similar.LEAST:
                    total += 1
                    ratio, at = similar.nearest(quote, text)
                    hits += ratio >= similar.LEAST
            if total:
                recall[words, kind, rate] = hits / total
    assert similar.common("abcde", "xbxdxe") == 3 and similar.common("", "a") == 0 and similar.common("日本", "本") == 1
    assert len(recall) >= 18 and min(recall.values()) >= 0.9, recall


def test_a_letter_in_every_third_word(spark):
    quote = "the method by which a reader finds what somebody else has written down before them is never stated in any book"
    words = quote.split()
    text = "Before. " + " ".join(w[:-1] + "q" if k % 3 == 0 else w for k, w in enumerate(words)) + ". After it."
    asked = spark.createDataFrame([(1, quote), (2, "zzz yyy xxx nothing of the sort"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text, 0), (2, quote.upper(), 0), (3, None, 0), (4, "", 0), (5, "other " * 900, 0)], "doc_id long, text string, at int")
    for block in (500_000, 20):
        got = {(r.quote_id, r.source_id): r.ratio for r in similar.near_quotations(asked, docs, block_chars=block).collect()}
        assert set(got) == {(1, 1), (1, 2)} and got[1, 2] == 1 and got[1, 1] > 0.9
    assert similar.near_quotations(asked, docs.limit(0)).collect() == [] and similar.near_quotations(asked.limit(0), docs).collect() == []


TEXT = "---\nfront: 1\n---\n# One\nprose\n<!-- p. 7 begins here -->\n## Sub\nmore prose here\n<!-- a\nb -->\n# Two\nend"


def test_lines(spark):
    src = lines.source_lines(spark.createDataFrame([(1, TEXT), (2, None)], "doc_id int, text string"))
    z = {r.line: r.zone for r in lines.zones(src).filter("source_id = 1").collect()}
    assert [z[i] for i in range(1, 13)] == ["front"] * 3 + ["heading", "prose", "comment", "heading", "prose", "comment", "comment", "heading", "prose"]
    assert {r.line: r.page for r in lines.pages(src).filter("source_id = 1").collect()}[8] == 7
    assert [(r.heading, r.line, r.end) for r in lines.headings(src).orderBy("line").collect()] == [("One", 4, 10), ("Sub", 7, 10), ("Two", 11, 12)]
    assert {r.source_id: r.words for r in lines.prose_words(lines.zones(src)).collect()} == {1: 5, 2: 0}


def test_contribution_roles(spark):
    edges = [("p", "main", "support"), ("q", "p", "support"), ("obj", "p", "attack"), ("reply", "obj", "attack"), ("x", "y", "contradictory"), ("a", "b", "support"), ("b", "a", "support"), ("m", "n", "contradictory"), ("m", "main", "support")]
    got = {r.node: (r.role, r.dist, r.dist_support) for r in graph.contribution(spark.createDataFrame(edges, "src string, dst string, kind string")).collect()}
    assert got["main"] == ("apex", 0, 0) and got["q"] == ("supports", 2, 2) and got["obj"] == ("engages", 2, None) and got["reply"] == ("engages", 3, None)
    assert got["a"] == ("inert", None, None) and got["x"][0] == got["y"][0] == "apex"
    load = {r.node: r.load for r in graph.closure_sizes(spark.createDataFrame(edges[:2], "src string, dst string, kind string")).collect()}
    assert load == {"main": 2, "p": 1, "q": 0}


def test_routes_loops_and_systems(spark):
    steps = spark.createDataFrame([("a", "b", "+", ""), ("b", "c", "-", "low"), ("b", "c", "+", "high"), ("c", "d", "+", "low"), ("c", "a", "-", ""), ("b", "d", "?", "")], "src string, dst string, sign string, regime string")
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    got = sorted((">".join(r.path), r.net) for r in graph.routes(steps, node("a"), node("d")).select("path", graph.net_sign(F.col("signs")).alias("net")).collect())
    assert got == [("a>b>c>d", "-"), ("a>b>d", "?")]  # one regime to a route
    assert sorted(">".join(r.loop) for r in graph.loops(steps).collect()) == ["a>b>c", "a>b>c"]
    assert sorted(r.node for r in graph.systems(steps).collect()) == ["a", "b", "c"]
    parts = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "src int, dst int")
    assert {r.component for r in graph.components(parts).collect()} == {0, 99}


def test_suppositions(spark):
    statements = spark.createDataFrame([(x,) for x in ("main", "p1", "p2", "p3", "obj")], "id string")
    arguments = spark.createDataFrame([("linked", "main"), ("alone", "main")], "arg string, concludes string")
    inputs = spark.createDataFrame([("linked", "p1"), ("linked", "p2"), ("alone", "p3")], "arg string, input string")
    attacks = spark.createDataFrame([("obj", "p3")], "src string, dst string")
    said = spark.createDataFrame([("one", "p1", False), ("both", "p1", False), ("both", "obj", True), ("cut", "p3", False), ("none", "obj", True)], "scenario string, id string, holds boolean")
    cuts = spark.createDataFrame([("cut", "linked")], "scenario string, arg string")
    closed = suppose.closed(said, attacks)
    after = suppose.holding(statements, arguments, inputs, closed, said.select("scenario"), cuts)
    held = {}
    for r in after.collect():
        held.setdefault(r.scenario, set()).add(r.id)
    assert "main" in held["one"] and "main" not in held["both"] and "main" not in held["cut"] and "p3" not in held["none"] and "main" in held["none"]
    lost = {(r.scenario, r.id) for r in suppose.losses(statements, after, closed.filter("NOT holds")).collect()}
    assert lost == {("both", "main"), ("cut", "main")}


def test_case_tables(spark):
    cells = spark.createDataFrame(
        [("r1", "x", "a"), ("r1", "y", "a"), ("r1", "v", "yes"), ("r2", "x", "a"), ("r2", "y", "b"), ("r2", "v", "no"), ("r3", "x", "a"), ("r3", "y", "a"), ("r3", "v", "no"), ("r4", "x", "a"), ("r4", "x", "b"), ("r4", "y", "a"), ("r5", "x", "impossible"), ("r5", "y", "b"), ("r5", "v", "yes")],
        "case_id string, frame string, value string",
    )
    pairs = {(r.a, r.b, r.dimension, r.verdict_a, r.verdict_b) for r in frames.differing_in_one(cells, ["x", "y"], "v").collect()}
    assert pairs == {("r1", "r2", "y", "yes", "no"), ("r2", "r3", "y", "no", "no")}
    assert [(r.x, r.y, r.cases) for r in frames.patterns_apart(cells, ["x", "y"], "v").collect()] == [("a", "a", 2)]
    assert {(r.case_id, r.meets) for r in frames.against_rule(cells, {"y": "a"}, "v", "yes").collect()} == {("r3", True), ("r5", False)}
    cases, names = cells.select("case_id").distinct(), cells.select("frame").distinct()
    assert [(r.case_id, r.frame) for r in frames.empty_cells(cells, cases, names).collect()] == [("r4", "v")]
    ranks = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1), (5, None, 0)], "case_id int, d int, e int")
    assert sorted(r.case_id for r in frames.dominated(ranks, ["d", "e"]).collect()) == [2, 3, 4]
    table = frames.conditions(spark.createDataFrame([(True, False, True), (True, True, True), (False, False, False)], "a boolean, b boolean, o boolean"), ["a", "b"], "o")
    assert [r.mask for r in frames.minimal_sufficient(table).collect()] == [1]
    edges = spark.createDataFrame([("r", "A", "support"), ("r", "B", "attack"), ("s", "A", "support"), ("t", "A", "support"), ("t", "A", "attack"), ("t", "B", "attack"), ("A", "B", "attack")], "src string, dst string, kind string")
    got = frames.bearing(edges, spark.createDataFrame([("A",), ("B",)], "account string"))
    assert {r.row_id: r.kind for r in frames.rows_of(got).collect()} == {"r": "apart", "s": "one", "t": "apart"}


def test_mechanism(spark):
    states = spark.createDataFrame([("m", "start", 0, "intervention"), ("m", "idle", 1, "condition"), ("m", "mid", 2, None), ("m", "with", 3, None), ("m", "stop", 4, None), ("m", "out", 5, "outcome"), ("m", "end", 6, None), ("n", "a", 0, None)], "map_id string, id string, ord int, role string")
    steps = spark.createDataFrame([("m", "start", "mid", "+", "", ["with"], []), ("m", "mid", "out", "-", "", [], ["stop"]), ("m", "mid", "end", "+", "", [], []), ("m", "mid", "lost", "+", "", [], [])], "map_id string, src string, dst string, sign string, regime string, jointly array<string>, unless array<string>")
    signs = {(r.src, r.dst): r.sign for r in mechanism.edges(steps).collect()}
    assert signs["with", "mid"] == "+" and signs["stop", "out"] == "+"
    assert {(r.map_id, r.kind, r.state) for r in mechanism.gaps(states, steps).collect()} == {("m", "unlinked-condition", "idle"), ("m", "dead-end", "end"), ("n", "no-intervention", None), ("n", "no-outcome", None)}
    on = lambda x: spark.createDataFrame([("m", x)], "map_id string, id string")
    at = lambda df: {r.node for r in df.collect()}
    assert "out" in at(mechanism.firing(states, steps)) and "mid" not in at(mechanism.firing(states, steps, fails=on("with")))
    assert {"mid", "end"} <= at(mechanism.firing(states, steps, holds=on("stop"))) and "out" not in at(mechanism.firing(states, steps, holds=on("stop")))
    assert [(r.field, r.name) for r in mechanism.undeclared(states, steps).collect()] == [("to", "lost")]
