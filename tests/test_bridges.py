"""What a small map says to the questions of its bridges."""

from enthyme.operators import bridges

STEP = "map_id string, title string, src string, dst string, sign string, regime string, period string, threshold string, given array<string>, layer string, stance string, basis string, scope string, `on` string, nul boolean, assoc boolean, selects boolean, necessary boolean, sufficient boolean, jointly array<string>, unless array<string>, via array<string>, measured_by array<string>"


def step(title, src, dst, sign="+", **given):
    row = dict(map_id="m", title=title, src=src, dst=dst, sign=sign, regime="", period="", threshold=None, given=[], layer="text", stance=None, basis="study", scope="", on="level", nul=False, assoc=False, selects=False, necessary=False, sufficient=False, jointly=[], unless=[], via=[], measured_by=[])
    return tuple((row | given).values())


def asked(spark, steps, premises, states):
    questions = spark.createDataFrame([(a, a) for a in bridges.PROBES] + [("fair?", None), ("odd?", "odd")], "question string, asks string")
    b = spark.createDataFrame([("m", arg, t) for arg, t in premises], "map_id string, arg string, title string")
    rows = bridges.bridge_questions(b, questions, spark.createDataFrame(steps, STEP), spark.createDataFrame([("m", *s) for s in states], "map_id string, id string, role string, kind string, status string"))
    return {(r.arg, r.question): (r.status, r.n, r.said) for r in rows.collect()}


def test_every_probe(spark):
    steps = [
        step("p", "fee", "use", "-", unless=["aid"], regime="war", scope="singular", threshold="a dollar", period="1990s", jointly=["rain"], given=["poor"], via=["cost"], measured_by=["count"]),
        step("p", "fee", "use", "-", unless=["aid"], regime="war", scope="singular", threshold="a dollar", period="1990s", jointly=["rain"], given=["poor"], via=["cost"], measured_by=["count"]),
        step("rival", "pride", "use", "-", layer="rival", stance="rejected", basis="asserted"),
        step("up", "need", "use", "+", necessary=True),
        step("on", "fee", "income", "+", on="stock"),
        step("aside", "fee", "anger", "+", on="trend", unless=["habit"]),
        step("back", "use", "fee", "+"),
        step("cause", "need", "fee", "+", basis="example"),
        step("end", "use", "health", "+", on="being"),
        step("null", "use", "sleep", "", nul=True),
    ]
    states = [("fee", "intervention", "price", None), ("use", None, None, "possible"), ("income", "outcome", None, None), ("health", "outcome", None, "open")]
    got = asked(spark, steps, [("x", "p"), ("x", "p"), ("y", "end"), ("z", "no such claim")], states)
    said = {q: s for (arg, q), (_, _, s) in got.items() if arg == "x"}
    assert said["counter"] == "a view the text reports: “pride” lowers “use” | “fee” lowers “use” past a threshold: a dollar | “fee” lowers “use” unless “aid” | “fee” lowers “use”, regime: war | “need” needed for “use”"
    assert said["rivals"] == "“pride” lowers “use” (rejected)" and said["otherroutes"] == "“need” needed for “use”"
    assert said["goals"] == "“fee” flows into “income”" and said["sideeffects"] == "“fee” speeds “anger”" and said["elsewhere"] == "“fee” flows into “income” | “fee” speeds “anger”"
    assert said["blockers"] == "“fee” lowers “use” unless “aid” | “fee” speeds “anger” unless “habit”" and said["common"] == "“need” leads to both “fee” and “use”"
    assert said["reverse"] == "“use” raises “fee” as well" and said["backing"] == "tested: 2 (study)" and said["howmany"] == "2 steps, in 1 settings: war"
    assert said["stops"] == "the chain goes on to “anger”, “health”, “income”, and stops there" and said["route"] == "“fee” lowers “use”"
    assert said["mediated"].count(" | ") == 4 and said["measure"].endswith("read from “count”") and said["onecase"].endswith("is about a single case")
    assert said["kinds"] == "“fee” is of the kind “price”" and said["possible"] == "“use” is a possibility the text sets out"
    assert said["support"] == "“fee” lowers “use” given poor | “fee” lowers “use” only together with “rain”" and said["scope"].count(" | ") == 3
    assert got["x", "fair?"] == ("reader", 0, "") == got["x", "odd?"]
    assert got["y", "counter"] == ("none", 0, "") and got["y", "possible"][2].count(" | ") == 1 and got["y", "route"][2] == "“use” makes “health”"
    assert {s for (arg, q), (s, _, _) in got.items() if arg == "z"} == {"none", "reader"}


def test_a_chain_that_closes_on_itself(spark):
    got = asked(spark, [step("p", "a", "b"), step("q", "b", "a", "-", on="character")], [("x", "p"), ("x", "q")], [("a", None, None, None)])
    assert got["x", "stops"][2].startswith("the chain closes on itself") and got["x", "route"][2] == "“a” raises “b”; “b” transforms “a”" and got["x", "goals"][0] == "none"
