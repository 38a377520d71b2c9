import pytest
from pyspark.sql import functions as F

from enthyme.operators import graph, mechanism, positions, profile, rules

STEP = "map_id string, title string, src string, dst string, sign string, regime string, period string, size string, given array<string>, layer string, stance string, basis string, design string, scope string, `on` string, nul boolean, assoc boolean, selects boolean, necessary boolean, sufficient boolean, jointly array<string>, unless array<string>, via array<string>"


def step(title, src, dst, sign="+", **more):
    base = {"regime": "", "period": "", "size": "", "given": [], "layer": "text", "stance": None, "basis": "study", "design": "", "scope": "", "on": "level", "nul": False, "assoc": False, "selects": False, "necessary": False, "sufficient": False, "jointly": [], "unless": [], "via": []}
    return {"map_id": "m", "title": title, "src": src, "dst": dst, "sign": sign, **base, **more}


@pytest.fixture(scope="module")
def steps(spark):
    names = [x.strip().split()[0].strip("`") for x in STEP.split(",")]
    return lambda *rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], STEP)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_views(steps, spark):
    s = steps(step("t", "a", "b", via=["c"]), step("t", "a", "c"), step("u", "c", "b", "-"), step("r", "a", "b", "-", layer="rival"), step("n", "a", "b", "0", nul=True, period="1990s"), step("x", "c", "a", layer="appraisal", basis="model"))
    assert values(profile.opened(s)) == [("m", "t", "a", "b")]
    assert values(profile.nulls(s)) == [("m", "a", "b", ["-"], ["1990s"])]
    assert values(profile.tiers(s)) == [("m", "evidence", 4), ("m", "imputed", 1)]
    got = {(r.state, r.src, r.title): r.opened_by for r in profile.accounts(s).collect()}
    assert got == {("b", "a", "t"): 0, ("b", "a", "r"): 0, ("b", "c", "u"): 1}
    kinds = spark.createDataFrame([("m", "a", "k", "a"), ("m", "c", "k", "z")], "map_id string, state string, kind string, general string")
    assert values(profile.kind_members(kinds)) == [("m", "k", ["a", "c"], "a")]
    assert values(profile.strata(s)) == [("m", "a", "b", 2)]
    empty = steps()
    for view in (profile.tiers, profile.strata, profile.accounts, profile.nulls, profile.opened, profile.transfers, profile.common_causes):
        assert view(empty).collect() == []


def test_narrowing(spark):
    rows = spark.createDataFrame([(None, ["x"]), (["x", "y"], None), (["x", "y"], ["y", "z"]), (["x"], ["z"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(profile.narrow(F.col("a"), F.col("b"))).collect()] == [["x"], ["x", "y"], ["y"], [], None]


def test_rules(steps, spark):
    s = steps(step("t", "a", "b", "-", via=["c"], necessary=True), step("t", "a", "c"), step("u", "c", "b"), step("v", "a", "d", via=["e"], basis="rumour"), step("w", "a", "a"))
    got = {(r.rule, r.subject) for r in rules.all_of([*rules.outside(s), *rules.consistency(s), *rules.via_routes(s)]).collect()}
    assert got == {("unknown-basis", "rumour"), ("necessary-against-sign", "a > b"), ("self-step", "a > a"), ("via-against-sign", "a > b"), ("via-not-stated", "a > d")}
    levels = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("m", "c", "a"), ("m", "d", "d"), ("m", "e", "q"), ("m", "f", None)], "map_id string, level string, parent string")
    assert {(r.rule, r.subject) for r in rules.all_of(rules.trees(levels, "level", "parent", "level")).collect()} == {("level-cycle", "a"), ("level-cycle", "b"), ("level-cycle", "c"), ("level-self", "d"), ("level-undeclared", "q")}
    states = spark.createDataFrame([], "map_id string, id string")
    assert [r.rule for r in rules.undeclared_cast(s, states).collect()] == ["no-states"]
    claims = spark.createDataFrame([("m", "x", "imputed", "w"), ("m", "y", "imputed", None), ("m", "z", None, "w")], "map_id string, title string, fidelity string, warrant string")
    premises = spark.createDataFrame([("m", "x")], "map_id string, title string")
    assert {(r.rule, r.title) for r in rules.all_of(rules.appraisal_claims(claims, premises)).collect()} == {("appraisal-not-imputed", "y"), ("appraisal-not-imputed", "z"), ("appraisal-as-premise", "x")}


def test_folding_two_states(spark):
    rows = spark.createDataFrame([("m", "text", a, b, s, t) for a, b, s, t in [("a", "b", "+", 0), ("b", "c", "-", 2), ("c", "d", "-", 1), ("b", "b", "+", 0), ("c", "a", "+", 0)]], "map_id string, layer string, src string, dst string, sign string, tier int")
    gone = spark.createDataFrame([("m", "b"), ("m", "c")], "map_id string, state string")
    assert values(positions.folded(rows, gone)) == [("m", "text", "a", "d", "+", 2)]


def fnv(text):
    h = 2166136261
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 16777619 % 2**32
    return f"{h:08x}"


def test_positions(spark):
    nodes = spark.createDataFrame([("m", "b", 3), ("m", "a", 3), ("m", "c", 1), ("m", "d", None)], "map_id string, node string, pos int")
    ranked = positions.ranks(nodes)
    assert values(ranked) == [("m", "a", 1), ("m", "b", 2), ("m", "c", 0)]
    edges = spark.createDataFrame([("m", "b", "c", "support"), ("m", "c", "a", "contrary")], "map_id string, src string, dst string, kind string")
    assert values(positions.reaches(edges, ranked)) == [("m", "b", "c", 2, 2), ("m", "c", "a", 0, -1)]
    assert positions.fingerprint(nodes, edges).first().fingerprint == fnv("a\nb\nc\nd\n\nb\tc\tsupport\nc\ta\tcontrary")
    named = spark.createDataFrame([("m", "s", "a"), ("m", "s", "b")], "map_id string, name string, node string")
    assert values(positions.inconsistent(named, edges)) == [("m", "s", ["a", "b"]), ("m", None, ["a", "c"])]
    titles = spark.createDataFrame([("Bridges do not collapse", "Bridges collapse"), ("Bridges collapse", "Bridges collapse"), ("No rain", "Snow")], "a string, b string")
    assert [r[0] for r in titles.select(positions.denies(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_deep_chains_have_no_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(104)], "src int, dst int")
    far = graph.distances(edges, spark.createDataFrame([(0,)], "node int"))
    assert far.agg(F.max("dist")).first()[0] == 104


def test_chain_profiles(steps, spark):
    s = steps(step("t", "a", "b"), step("u", "b", "c"), step("v", "x", "y"))
    chains = spark.createDataFrame([("m", "one", "t"), ("m", "one", "u"), ("m", "two", "v")], "map_id string, chain string, title string")
    states = spark.createDataFrame([("m", "a", "intervention"), ("m", "b", None), ("m", "c", "outcome"), ("m", "x", None), ("m", "y", None)], "map_id string, id string, role string")
    assert values(profile.chain_profiles(chains, states, s)) == [("m", "one", 2, 3, 1, 0), ("m", "two", 1, 2, 1, 1)]
    assert mechanism.reached(s, spark.createDataFrame([("m", "a")], "map_id string, node string")).count() == 3


def test_shortest_loops_are_found_without_listing_all(spark):
    """A graph with more loops than could be listed, and systems with loops of several lengths."""
    import random

    dense = [(f"d{i:02}", f"d{j:02}") for i in range(16) for j in range(16) if i != j]
    rng = random.Random(2)
    sparse = sorted({(f"s{rng.randrange(14):02}", f"s{rng.randrange(14):02}") for _ in range(24)})
    sparse = [e for e in sparse if e[0] != e[1]]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r0", "out")]
    steps = spark.createDataFrame([(a, b, "+") for a, b in dense + sparse + ring], "src string, dst string, sign string")
    got = {}
    for r in profile.shortest_loops(steps, 3).collect():
        got.setdefault(r.system, []).append((r.place, tuple(r.loop)))

    def shortest(edges, v):
        """The first of the shortest loops through v, by trying all paths."""
        level = [(v,)]
        while level:
            if closed := sorted(p for p in level if (p[-1], v) in edges):
                return closed[0]
            level = [(*p, b) for p in level for a, b in edges if a == p[-1] and b not in p]
        return None

    edges = set(sparse)
    loops = {min((p[i:] + p[:i]) for i in range(len(p))) for v in {a for e in edges for a in e} if (p := shortest(edges, v))}
    reach = {v: {v} for e in edges for v in e}
    for _ in reach:
        for a, b in edges:
            reach[a] |= reach[b]
    by_system = {}
    for loop in sorted(loops, key=lambda x: (len(x), x)):
        by_system.setdefault(min(u for u in reach if u in reach[loop[0]] and loop[0] in reach[u]), []).append(loop)
    assert {s: [x for _, x in sorted(v)] for s, v in got.items() if s.startswith("s")} == {s: v[:3] for s, v in by_system.items()}
    assert sorted(got["d00"]) == [(1, ("d00", "d01")), (2, ("d00", "d02")), (3, ("d00", "d03"))]
    assert got["r0"] == [(1, ("r0", "r1", "r2", "r3", "r4"))] and "out" not in got
    assert profile.shortest_loops(steps.limit(0)).collect() == []
