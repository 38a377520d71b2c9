"""Queries of causal chains and of positions in a text, over chains read out of the orders: a map per priority, a step per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bridges, graph, positions, profile, rules
from .catalog import TRANSITIONS, _transitions, query
from .tables import table

S = """s AS (SELECT o_orderpriority AS map_id, 't' || (o_orderkey % 40) AS title, 'n' || (o_custkey % 9) AS src, 'n' || ((o_orderkey // 4) % 10) AS dst,
 CASE o_custkey % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+' WHEN 3 THEN '0' ELSE 'which' END AS sign,
 CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'P' THEN 'part' ELSE '' END AS regime, CASE WHEN o_orderkey % 5 = 0 THEN 'early' ELSE '' END AS period, CASE WHEN o_custkey % 8 = 0 THEN 'large' ELSE '' END AS size,
 CASE WHEN o_custkey % 7 = 0 THEN 'c' || (o_custkey % 3) ELSE '' END AS condition, CASE o_orderkey % 11 WHEN 0 THEN 'rival' WHEN 1 THEN 'appraisal' ELSE 'text' END AS layer,
 CASE WHEN o_orderkey % 13 = 0 THEN 'rejected' WHEN o_orderkey % 13 = 1 THEN 'shared' END AS stance,
 CASE o_orderkey % 7 WHEN 0 THEN 'study' WHEN 1 THEN 'statistics' WHEN 2 THEN 'model' WHEN 3 THEN 'example' WHEN 4 THEN 'testimony' WHEN 5 THEN 'asserted' ELSE 'hearsay' END AS basis,
 CASE WHEN o_custkey % 17 = 0 THEN 'illustration' WHEN o_custkey % 17 = 1 THEN 'case study' ELSE '' END AS design, CASE o_custkey % 7 WHEN 0 THEN 'general' WHEN 1 THEN 'singular' ELSE '' END AS scope,
 CASE o_orderkey % 9 WHEN 0 THEN 'being' WHEN 1 THEN 'stock' WHEN 2 THEN 'character' WHEN 3 THEN 'whim' ELSE 'level' END AS "on",
 o_orderkey % 16 = 0 AS nul, o_custkey % 19 = 0 AS assoc, o_custkey % 31 = 0 AS selects, o_custkey % 23 = 0 AS necessary, o_custkey % 29 = 0 AS sufficient,
 CASE WHEN o_custkey % 37 = 0 THEN 'n' || (o_custkey % 11) END AS also, CASE WHEN o_custkey % 41 = 0 THEN 'n' || (o_orderkey % 9) END AS blocker, CASE WHEN o_custkey % 43 = 0 THEN 'n' || (o_orderkey % 9) END AS through FROM orders),
causal AS (SELECT * FROM s WHERE NOT nul AND NOT assoc AND NOT selects), own AS (SELECT * FROM s WHERE layer = 'text'), said AS (SELECT * FROM causal WHERE layer = 'text')"""


def _steps(spark, d, map_id=None) -> DataFrame:
    def pick(value, *cases, last=None):
        out = F.lit(last)
        for k, v in reversed(cases):
            out = F.when(value == k, v).otherwise(out)
        return out

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    one = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    columns = {
        "map_id": F.col("o_orderpriority") if map_id is None else map_id,
        "title": F.concat(F.lit("t"), (key % 40).cast("string")),
        "src": node(cust % 9),
        "dst": node(F.floor(key / 4) % 10),
        "sign": pick(cust % 5, (0, "+"), (1, "-"), (2, "+"), (3, "0"), last="which"),
        "regime": pick(F.col("o_orderstatus"), ("F", "full"), ("P", "part"), last=""),
        "period": F.when(key % 5 == 0, "early").otherwise(""),
        "size": F.when(cust % 8 == 0, "large").otherwise(""),
        "given": F.when(cust % 7 == 0, F.array(F.concat(F.lit("c"), (cust % 3).cast("string")))).otherwise(F.array().cast("array<string>")),
        "layer": pick(key % 11, (0, "rival"), (1, "appraisal"), last="text"),
        "stance": F.when(key % 13 == 0, "rejected").when(key % 13 == 1, "shared"),
        "basis": pick(key % 7, (0, "study"), (1, "statistics"), (2, "model"), (3, "example"), (4, "testimony"), (5, "asserted"), last="hearsay"),
        "design": pick(cust % 17, (0, "illustration"), (1, "case study"), last=""),
        "scope": pick(cust % 7, (0, "general"), (1, "singular"), last=""),
        "on": pick(key % 9, (0, "being"), (1, "stock"), (2, "character"), (3, "whim"), last="level"),
        "nul": key % 16 == 0,
        "assoc": cust % 19 == 0,
        "selects": cust % 31 == 0,
        "necessary": cust % 23 == 0,
        "sufficient": cust % 29 == 0,
        "jointly": one(F.when(cust % 37 == 0, node(cust % 11))),
        "unless": one(F.when(cust % 41 == 0, node(key % 9))),
        "via": one(F.when(cust % 43 == 0, node(key % 9))),
    }
    return table(spark, d, "orders").select(*(v.alias(k) for k, v in columns.items()))


def _constitutions(steps: DataFrame) -> DataFrame:
    return steps.filter("selects").select("map_id", "title", "src", "dst", "layer")


def _relations(steps: DataFrame) -> DataFrame:
    attacks, n = F.col("nul") | (F.col("sign") == "-"), F.substring("dst", 2, 9).cast("int")
    rows = steps.filter("src = 'n3'").select("map_id", F.col("title").alias("a"), F.concat(F.lit("t"), F.when(attacks, n * 4 + 1).otherwise(n)).alias("b"), F.when(attacks, "attack").otherwise("support").alias("kind"))
    return rows.distinct()


RELATIONS = "rel AS (SELECT DISTINCT map_id, title AS a, 't' || CASE WHEN nul OR sign = '-' THEN substring(dst, 2)::INT * 4 + 1 ELSE substring(dst, 2)::INT END AS b, CASE WHEN nul OR sign = '-' THEN 'attack' ELSE 'support' END AS kind FROM s WHERE src = 'n3')"


def _kinds(steps: DataFrame) -> DataFrame:
    ends = steps.select("map_id", F.col("src").alias("state")).union(steps.select("map_id", "dst")).distinct()
    n = F.substring("state", 2, 9).cast("int") % 4
    return ends.select("map_id", "state", F.concat(F.lit("k"), n).alias("kind"), F.concat(F.lit("n"), n).alias("general")).filter("state NOT IN ('n8', 'n9')")


KINDS = "ends AS (SELECT map_id, src AS state FROM s UNION SELECT map_id, dst FROM s), kinds AS (SELECT map_id, state, 'k' || (substring(state, 2)::INT % 4) AS kind, 'n' || (substring(state, 2)::INT % 4) AS general FROM ends WHERE state NOT IN ('n8', 'n9'))"


def _states(steps: DataFrame) -> DataFrame:
    """States n0 to n8 are declared; n7 is the reader's own; part_of nests them with a cycle and a stranger."""
    ends = steps.select("map_id", F.col("src").alias("id")).distinct()
    n = F.substring("id", 2, 9).cast("int")
    part = F.when(n == 1, "n2").when(n == 2, "n3").when(n == 3, "n1").when(n == 4, "n4").when(n == 5, "n99").when(n == 6, "n0")
    return ends.select("map_id", "id", (n == 7).alias("appraisal"), part.alias("part_of"), F.when(n < 2, "intervention").when(n == 8, "outcome").alias("role"))


STATES = "states AS (SELECT map_id, id, n = 7 AS appraisal, CASE n WHEN 1 THEN 'n2' WHEN 2 THEN 'n3' WHEN 3 THEN 'n1' WHEN 4 THEN 'n4' WHEN 5 THEN 'n99' WHEN 6 THEN 'n0' END AS part_of, CASE WHEN n < 2 THEN 'intervention' WHEN n = 8 THEN 'outcome' END AS role FROM (SELECT DISTINCT map_id, src AS id, substring(src, 2)::INT AS n FROM s))"

joined = lambda c: F.array_join(c, ",")


# ---------------------------------------------------------------- views
@query(f"""WITH {S}, r AS (SELECT map_id, src, dst, sign, min(CASE WHEN layer = 'appraisal' THEN 3 WHEN basis IN ('study', 'statistics', 'model') THEN 0 WHEN basis IN ('example', 'testimony') THEN 1 ELSE 2 END) AS k FROM causal GROUP BY ALL)
SELECT map_id, ['evidence', 'argued', 'asserted', 'imputed'][k + 1] AS tier, count(*) AS n FROM r GROUP BY 1, 2""")
def chain_tiers(spark, d):
    return profile.tiers(_steps(spark, d))


@query(f"""WITH {S}, e AS (SELECT map_id, src, dst, sign FROM s UNION SELECT map_id, also, dst, sign FROM s WHERE also IS NOT NULL
 UNION SELECT map_id, blocker, dst, CASE sign WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE '?' END FROM s WHERE blocker IS NOT NULL)
SELECT map_id, src, dst, string_agg(DISTINCT sign, ',' ORDER BY sign) AS signs FROM e WHERE src <> dst GROUP BY ALL""")
def chain_sign_sets(spark, d):
    return profile.sign_sets(_steps(spark, d)).withColumn("signs", joined("signs"))


@query(f"""WITH {S} SELECT map_id, src, dst, CASE WHEN bool_or(regime = '') THEN NULL ELSE string_agg(DISTINCT regime, ',' ORDER BY regime) END AS regimes, CASE WHEN bool_or(period = '') THEN NULL ELSE string_agg(DISTINCT period, ',' ORDER BY period) END AS periods FROM causal GROUP BY ALL""")
def chain_regime_sets(spark, d):
    return profile.regime_sets(_steps(spark, d)).withColumns({"regimes": joined("regimes"), "periods": joined("periods")})


@query(f"""WITH {S} SELECT map_id, src, dst, count(DISTINCT (sign, condition, period, size)) AS records FROM own WHERE NOT assoc AND NOT selects GROUP BY ALL
HAVING count(DISTINCT (sign, condition, period, size)) > 1 AND bool_or(condition <> '' OR period <> '')""")
def chain_strata(spark, d):
    return profile.strata(_steps(spark, d))


@query(f"""WITH {S}, f AS (SELECT map_id, src, dst, coalesce(string_agg(DISTINCT nullif(period, ''), ',' ORDER BY nullif(period, '')), '') AS periods FROM own WHERE nul GROUP BY ALL),
r AS (SELECT map_id, src, dst, string_agg(DISTINCT sign, ',' ORDER BY sign) AS refutes FROM s WHERE layer = 'rival' AND NOT nul AND sign <> '' GROUP BY ALL)
SELECT map_id, src, dst, coalesce(refutes, '') AS refutes, periods FROM f LEFT JOIN r USING (map_id, src, dst)""")
def chain_nulls(spark, d):
    return profile.nulls(_steps(spark, d)).withColumns({"refutes": joined("refutes"), "periods": joined("periods")})


@query(f"""WITH {S}, {RELATIONS}, against AS (SELECT DISTINCT map_id, least(a, b) AS x, greatest(a, b) AS y FROM rel WHERE kind = 'attack' AND a <> b), t AS (SELECT DISTINCT map_id, src, dst, title FROM s WHERE NOT assoc AND NOT selects)
SELECT p.map_id, p.src, p.dst, x, y FROM against a JOIN t p ON p.map_id = a.map_id AND p.title = x JOIN t q ON q.map_id = a.map_id AND q.title = y AND q.src = p.src AND q.dst = p.dst""")
def chain_disputed(spark, d):
    steps = _steps(spark, d)
    return profile.disputed(steps, _relations(steps))


@query(f"""WITH {S}, c AS (SELECT * FROM causal WHERE layer <> 'appraisal'), st AS (SELECT map_id, dst FROM c GROUP BY ALL HAVING count(DISTINCT title) > 1 AND bool_or(layer = 'rival' OR stance IS NOT NULL))
SELECT e.map_id, e.dst AS state, e.src, e.title, (SELECT count(DISTINCT (i.src, i.title)) FROM c i WHERE i.map_id = e.map_id AND i.dst = e.src AND i.title <> e.title) AS opened_by
FROM (SELECT DISTINCT map_id, dst, src, title FROM c) e JOIN st USING (map_id, dst)""")
def chain_accounts(spark, d):
    return profile.accounts(_steps(spark, d))


AKIN = f"""{KINDS}, ed AS (SELECT DISTINCT map_id, src, dst FROM said),
g AS (SELECT ed.*, coalesce('kind ' || a.kind, 'state ' || src) AS ks, coalesce('kind ' || b.kind, 'state ' || dst) AS kd, a.general AS sg, b.general AS dg FROM ed LEFT JOIN kinds a ON a.map_id = ed.map_id AND a.state = src LEFT JOIN kinds b ON b.map_id = ed.map_id AND b.state = dst),
pr AS (SELECT a.map_id, a.src AS a_src, a.dst AS a_dst, b.src AS b_src, b.dst AS b_dst, (a.src = b.src OR coalesce(a.src = b.sg, false)) AND (a.dst = b.dst OR coalesce(a.dst = b.dg, false)) AS ov,
 (b.src = a.src OR coalesce(b.src = a.sg, false)) AND (b.dst = a.dst OR coalesce(b.dst = a.dg, false)) AS un FROM g a JOIN g b USING (map_id, ks, kd) WHERE (a.src, a.dst) <> (b.src, b.dst)),
akin AS (SELECT map_id, a_src, a_dst, b_src, b_dst, ov AS instance FROM pr WHERE CASE WHEN ov AND un THEN (a_src, a_dst) < (b_src, b_dst) ELSE ov OR (NOT un AND (a_src, a_dst) < (b_src, b_dst)) END)"""


@query(f"WITH {S}, {AKIN} SELECT * FROM akin")
def chain_akin_steps(spark, d):
    steps = _steps(spark, d)
    return profile.akin(steps, _kinds(steps))


CASES = f"""{AKIN}, cases AS (SELECT map_id, src, dst, (SELECT count(DISTINCT title) FROM own o WHERE o.scope = 'singular' AND o.map_id = g0.map_id AND o.src = g0.src AND o.dst = g0.dst)
 + (SELECT count(*) FROM akin WHERE instance AND akin.map_id = g0.map_id AND a_src = g0.src AND a_dst = g0.dst) AS cases FROM (SELECT DISTINCT map_id, src, dst FROM own WHERE scope = 'general') g0)"""


@query(f"WITH {S}, {CASES} SELECT * FROM cases")
def chain_cases(spark, d):
    steps = _steps(spark, d)
    return profile.cases(steps, profile.akin(steps, _kinds(steps)))


@query(f"WITH {S}, {CASES} SELECT DISTINCT map_id, src, dst, title FROM own JOIN cases USING (map_id, src, dst) WHERE scope = 'general' AND cases <= 1 AND (basis = 'example' OR design IN ('case study', 'anecdote'))")
def chain_one_case(spark, d):
    steps = _steps(spark, d)
    return profile.one_case(steps, profile.akin(steps, _kinds(steps)))


@query(f"WITH {S} SELECT DISTINCT map_id, src, dst FROM own a WHERE scope = 'general' AND EXISTS (SELECT 1 FROM own b WHERE b.scope = 'singular' AND b.map_id = a.map_id AND b.src = a.src AND b.dst = a.dst)")
def chain_extrapolated(spark, d):
    return profile.extrapolated(_steps(spark, d))


@query(f"""WITH {S}, e AS (SELECT DISTINCT map_id, src, dst FROM said), a AS (SELECT DISTINCT map_id, src, dst FROM s WHERE assoc AND layer <> 'appraisal')
SELECT a.map_id, a.src, a.dst, x.src AS cause FROM a JOIN e x ON x.map_id = a.map_id AND x.dst = a.src JOIN e y ON y.map_id = a.map_id AND y.src = x.src AND y.dst = a.dst""")
def chain_common_causes(spark, d):
    return profile.common_causes(_steps(spark, d))


@query(f"""WITH {S}, r AS (SELECT DISTINCT map_id, regime, src, dst, sign FROM causal WHERE regime <> '')
SELECT * FROM r WHERE (SELECT count(DISTINCT regime) FROM r x WHERE x.map_id = r.map_id) > 1 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.map_id = r.map_id AND x.src = r.src AND x.dst = r.dst AND x.sign = r.sign AND x.regime <> r.regime)""")
def chain_transfers(spark, d):
    return profile.transfers(_steps(spark, d))


@query(f"WITH {S}, c AS (SELECT DISTINCT map_id, src, dst FROM own WHERE selects) SELECT DISTINCT map_id, src, dst FROM said JOIN c USING (map_id, src, dst)")
def chain_both(spark, d):
    steps = _steps(spark, d)
    return profile.both_ways(steps, _constitutions(steps))


@query(f"""WITH {S} SELECT DISTINCT c.map_id, c.src, c.dst, a.layer AS causal_layer, c.layer AS constitutive_layer FROM s c JOIN causal a USING (map_id, src, dst) WHERE c.selects AND c.layer <> 'appraisal' AND a.layer <> 'appraisal' AND a.layer <> c.layer""")
def chain_readings(spark, d):
    steps = _steps(spark, d)
    return profile.readings(steps, _constitutions(steps))


@query(f"WITH {S}, c AS (SELECT DISTINCT map_id, src, dst FROM own WHERE selects) SELECT DISTINCT a.map_id, least(a.src, a.dst) AS x, greatest(a.src, a.dst) AS y FROM c a JOIN c b ON a.map_id = b.map_id AND a.src = b.dst AND a.dst = b.src")
def chain_mutual(spark, d):
    return profile.mutual(_constitutions(_steps(spark, d)))


FLAGS = ("necessary", "sufficient", "nul", "selects", "assoc")


@query(f"WITH {S} " + " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS flag, map_id, src, dst, sign FROM s WHERE {f} AND layer <> 'appraisal'" for f in FLAGS))
def chain_flags(spark, d):
    steps = _steps(spark, d)
    return rules.all_of([profile.flagged(steps, f).select(F.lit(f).alias("flag"), "map_id", "src", "dst", "sign") for f in FLAGS])


CENSUSES = ("design", "stance", "scope", "on", "basis", "size")


@query(f"WITH {S} " + " UNION ALL ".join(f"""SELECT '{c}' AS field, map_id, "{c}" AS value, count(*) AS n FROM own WHERE "{c}" <> '' GROUP BY ALL""" for c in CENSUSES))
def chain_census(spark, d):
    steps = _steps(spark, d)
    return rules.all_of([profile.census(steps, c).select(F.lit(c).alias("field"), "map_id", "value", "n") for c in CENSUSES])


@query(f"WITH {S}, {STATES} SELECT map_id, part_of AS whole, string_agg(DISTINCT id, ',' ORDER BY id) AS parts FROM states WHERE part_of IS NOT NULL GROUP BY ALL")
def chain_wholes(spark, d):
    return profile.wholes(_states(_steps(spark, d)).withColumnRenamed("id", "state")).withColumn("parts", joined("parts"))


@query(f"WITH {S}, {KINDS} SELECT map_id, kind, string_agg(DISTINCT state, ',' ORDER BY state) AS members, CASE WHEN bool_or(state = general) THEN min(general) END AS general FROM kinds GROUP BY ALL")
def chain_kinds(spark, d):
    return profile.kind_members(_kinds(_steps(spark, d))).withColumn("members", joined("members"))


@query(f"""WITH {S}, e AS (SELECT DISTINCT map_id, src, dst FROM said)
SELECT DISTINCT o.map_id, o.title, o.src, o.dst FROM own o JOIN e x ON x.map_id = o.map_id AND x.src = o.src AND x.dst = through JOIN e y ON y.map_id = o.map_id AND y.src = through AND y.dst = o.dst""")
def chain_opened(spark, d):
    return profile.opened(_steps(spark, d))


LOOPS = f"""WITH RECURSIVE {TRANSITIONS}, r AS (SELECT DISTINCT src AS start, src AS place, [src] AS path, false AS closed, true AS keep, false AS stock FROM steps UNION ALL
 SELECT start, dst, CASE WHEN dst = start THEN path ELSE list_append(path, dst) END, dst = start, keep AND sign = '+', stock OR src = 'purchase' FROM r JOIN steps ON src = place WHERE NOT closed AND dst >= start AND (dst = start OR NOT list_contains(path, dst)))"""


def _natured(steps: DataFrame) -> DataFrame:
    return steps.withColumn("on", F.when(F.col("src") == "purchase", "stock").otherwise("being"))


@query(f"{LOOPS} SELECT array_to_string(path, '>') AS loop FROM r WHERE closed AND keep AND NOT stock")
def sustaining_loops(spark, d):
    steps = _transitions(spark, d)
    return profile.sustaining(graph.loops(steps), _natured(steps)).select(F.array_join("loop", ">").alias("loop"))


@query(f"{LOOPS} SELECT array_to_string(path, '>') AS loop FROM r WHERE closed AND stock")
def stock_loops(spark, d):
    steps = _transitions(spark, d)
    return profile.stock_loops(graph.loops(steps), _natured(steps)).select(F.array_join("loop", ">").alias("loop"))


@query(f"""WITH RECURSIVE {TRANSITIONS}, f AS (SELECT DISTINCT src AS start, src AS place, [src] AS path, false AS closed FROM steps UNION ALL
 SELECT start, dst, CASE WHEN dst = start THEN path ELSE list_append(path, dst) END, dst = start FROM f JOIN steps ON src = place WHERE NOT closed AND (dst = start OR NOT list_contains(path, dst))),
shortest AS (SELECT start, arg_min(path, (len(path), path)) AS path FROM f WHERE closed GROUP BY 1),
turned AS (SELECT DISTINCT list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS loop FROM shortest),
reach AS (SELECT src, dst FROM steps UNION SELECT q.src, steps.dst FROM reach q JOIN steps ON steps.src = q.dst),
sys AS (SELECT a.src AS node, min(a.dst) AS system FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT system, array_to_string(loop, '>') AS loop, k AS place FROM (SELECT system, loop, (row_number() OVER (PARTITION BY system ORDER BY len(loop), loop))::INT AS k FROM turned JOIN sys ON node = loop[1]) WHERE k <= 3""")
def shortest_loops(spark, d):
    return profile.shortest_loops(_transitions(spark, d)).withColumn("loop", F.array_join("loop", ">"))


@query()
def chain_profiles(spark, d):
    """Each priority's claims in four chains. Rows only; the entries and gaps are held against their SQL in chain_gaps."""
    steps, states = _steps(spark, d), _states(_steps(spark, d))
    chains = steps.select("map_id", F.concat(F.lit("chain "), F.substring("title", 2, 9).cast("int") % 4).alias("chain"), "title").distinct()
    return profile.chain_profiles(chains, states.select("map_id", "id", "role"), steps)


@query(f"""WITH {S}, {STATES}, reasons AS (SELECT DISTINCT map_id, title FROM s WHERE basis = 'hearsay' AND src = 'n8') SELECT map_id, id AS state FROM states st WHERE EXISTS (SELECT 1 FROM s JOIN reasons USING (map_id, title) WHERE s.map_id = st.map_id AND st.id IN (s.src, s.dst))""")
def chain_taken_up(spark, d):
    steps = _steps(spark, d)
    gaps = _states(steps).select("map_id", F.lit("dead-end").alias("kind"), F.col("id").alias("state"))
    return profile.taken_up(gaps, steps, steps.filter("basis = 'hearsay' AND src = 'n8'").select("map_id", "title").distinct()).drop("kind")


# ---------------------------------------------------------------- rules
def sql_rule(rule, severity, subject, rows, title="title"):
    return f"SELECT DISTINCT map_id, '{rule}' AS rule, '{severity}' AS severity, {title} AS title, {subject} AS subject FROM {rows}"


def sql_values(field, known, severity):
    return sql_rule(f"unknown-{field}", severity, f'"{field}"', f"""s WHERE "{field}" IS NOT NULL AND "{field}" <> '' AND "{field}" NOT IN ({", ".join(f"'{k}'" for k in known)})""")


PAIR = "src || ' > ' || dst"
VALUES = [sql_values(*x) for x in (("sign", rules.SIGNS, "!"), ("basis", rules.BASES, "?"), ("stance", rules.STANCES, "!"), ("scope", rules.SCOPES, "?"), ("on", rules.ONS, "!"))]


@query(f"WITH {S} " + " UNION ALL ".join(VALUES))
def rule_values(spark, d):
    return rules.all_of(rules.outside(_steps(spark, d)))


NATURES = ", ".join(f"'{x}'" for x in rules.NATURES)


@query(f"WITH {S} " + " UNION ALL ".join(sql_rule(rule, "!" if rule == "self-step" else "?", PAIR, f"s WHERE {when}") for rule, when in (
    ("necessary-against-sign", "necessary AND sign IN ('-', '0')"), ("sufficient-without-effect", "sufficient AND sign = '0'"), ("sufficient-without-cause", "sufficient AND (nul OR selects OR assoc)"),
    ("illustration-as-test", "design = 'illustration' AND basis IN ('study', 'statistics', 'model')"), ("character-with-degree", "\"on\" = 'character' AND sign IN ('+', '-', '0')"),
    ("nature-without-direction", f"\"on\" IN ({NATURES}) AND sign = 'which'"), ("stance-on-own-view", "stance IS NOT NULL AND layer = 'text'"), ("self-step", "src = dst"))))
def rule_consistency(spark, d):
    return rules.all_of(rules.consistency(_steps(spark, d)))


REFERENCES = [sql_rule(f"undeclared-{f}", "!", c, f"s WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM states x WHERE x.map_id = s.map_id AND x.id = {c})") for f, c in (("src", "src"), ("dst", "dst"), ("via", "through"), ("unless", "blocker"), ("jointly", "also"))]
REFERENCES += [sql_rule(f"own-end-{f}", "?", c, f"s WHERE {c} IN (src, dst)") for f, c in (("via", "through"), ("unless", "blocker"), ("jointly", "also"))]


@query(f"WITH {S}, {STATES} " + " UNION ALL ".join(REFERENCES))
def rule_references(spark, d):
    steps = _steps(spark, d)
    return rules.all_of(rules.references(steps, _states(steps)))


@query(f"WITH {S}, {STATES} " + sql_rule("text-through-appraisal", "!", "id", "s JOIN states USING (map_id) WHERE appraisal AND layer <> 'appraisal' AND id IN (src, dst)"))
def rule_through_appraisal(spark, d):
    steps = _steps(spark, d)
    return rules.all_of([rules.through_appraisal(steps, _states(steps))])


@query(f"WITH RECURSIVE {S}, {STATES}, up AS (SELECT map_id, id AS a, part_of AS b FROM states WHERE part_of <> id UNION SELECT up.map_id, a, part_of FROM up JOIN states st ON st.map_id = up.map_id AND st.id = b WHERE part_of <> id) "
       + sql_rule("part-undeclared", "!", "part_of", "states p WHERE part_of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM states x WHERE x.map_id = p.map_id AND x.id = p.part_of)", "NULL")
       + " UNION ALL " + sql_rule("part-self", "!", "id", "states WHERE id = part_of", "NULL") + " UNION ALL " + sql_rule("part-cycle", "!", "a", "up WHERE a = b", "NULL"))
def rule_parts(spark, d):
    return rules.all_of(rules.trees(_states(_steps(spark, d)), "id", "part_of", "part"))


VIA = """sg AS (SELECT map_id, src, dst, CASE WHEN count(DISTINCT sign) = 1 THEN min(sign) ELSE '?' END AS h FROM said GROUP BY ALL),
v AS (SELECT DISTINCT o.map_id, o.title, o.src, o.dst, o.through, o.sign, x.h AS h1, y.h AS h2 FROM said o LEFT JOIN sg x ON x.map_id = o.map_id AND x.src = o.src AND x.dst = o.through LEFT JOIN sg y ON y.map_id = o.map_id AND y.src = o.through AND y.dst = o.dst WHERE o.through IS NOT NULL)"""


#: A map for each claim, priority and tenth of the customers, so that hops have one sign.
FINE = S.replace("o_orderpriority AS map_id", "o_orderpriority || ' t' || (o_orderkey % 40) || ' ' || (o_custkey % 10) AS map_id")


@query(f"WITH {FINE}, {VIA} " + sql_rule("via-not-stated", "?", PAIR, "v WHERE h1 IS NULL OR h2 IS NULL") + " UNION ALL "
       + sql_rule("via-against-sign", "?", PAIR, "v WHERE h1 IN ('+', '-') AND h2 IN ('+', '-') AND sign IN ('+', '-') AND CASE WHEN h1 = h2 THEN '+' ELSE '-' END <> sign"))
def rule_via_routes(spark, d):
    tenth = F.concat(F.col("o_orderpriority"), F.lit(" t"), (F.col("o_orderkey") % 40).cast("string"), F.lit(" "), (F.col("o_custkey") % 10).cast("string"))
    return rules.all_of(rules.via_routes(_steps(spark, d, tenth)))


CHAINS = "claims AS (SELECT DISTINCT map_id, 'chain ' || (substring(title, 2)::INT % 4) AS chain, title FROM s), declared AS (SELECT DISTINCT map_id, 'chain ' || k AS chain FROM s, range(1, 6) AS g(k))"


@query(f"WITH {S}, {CHAINS} " + sql_rule("unknown-chain", "!", "chain", "claims c WHERE NOT EXISTS (SELECT 1 FROM declared x WHERE x.map_id = c.map_id AND x.chain = c.chain)") + " UNION ALL "
       + sql_rule("chain-without-step", "?", "chain", "declared x WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE x.map_id = c.map_id AND x.chain = c.chain)", "NULL"))
def rule_chains(spark, d):
    steps = _steps(spark, d)
    claims = steps.select("map_id", F.concat(F.lit("chain "), F.substring("title", 2, 9).cast("int") % 4).alias("chain"), "title").distinct()
    declared = steps.select("map_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("map_id", F.concat(F.lit("chain "), "k").alias("chain")).distinct()
    return rules.all_of(rules.chain_rules(declared, claims, steps))


@query(f"WITH {S}, {STATES} " + sql_rule("constitution-undeclared", "!", "n", "(SELECT map_id, title, unnest([src, dst]) AS n FROM s WHERE selects) c WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.map_id = c.map_id AND x.id = n)") + " UNION ALL " + sql_rule("constitution-self", "!", "src", "s WHERE selects AND src = dst"))
def rule_constitutions(spark, d):
    steps = _steps(spark, d)
    return rules.all_of(rules.constitutive(_constitutions(steps), _states(steps)))


# ---------------------------------------------------------------- positions
POS = "nodes AS (SELECT map_id, title AS node, min(o) AS pos FROM (SELECT o_orderpriority AS map_id, 't' || (o_orderkey % 40) AS title, (o_orderkey * 7) % 1009 AS o FROM orders) GROUP BY ALL), rk AS (SELECT map_id, node, row_number() OVER (PARTITION BY map_id ORDER BY pos, node) - 1 AS rank FROM nodes)"


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("map_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 40).cast("string")).alias("node")).agg(F.min(F.col("o_orderkey") * 7 % 1009).alias("pos"))


@query(f"WITH {POS} SELECT map_id, node, rank::INT AS rank FROM rk")
def claim_ranks(spark, d):
    return positions.ranks(_nodes(spark, d)).withColumn("rank", F.col("rank").cast("int"))


REACH = f"{S}, {POS}, {RELATIONS}, re AS (SELECT rel.map_id, a, b, x.rank AS stands, x.rank - y.rank AS reach FROM rel JOIN rk x ON x.map_id = rel.map_id AND x.node = a JOIN rk y ON y.map_id = rel.map_id AND y.node = b)"


def _reach(spark, d) -> DataFrame:
    edges = _relations(_steps(spark, d)).select("map_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return positions.reaches(edges, positions.ranks(_nodes(spark, d)))


@query(f"WITH {REACH} SELECT map_id, a AS src, b AS dst, stands::INT AS \"at\", reach::INT AS reach FROM re")
def reason_reaches(spark, d):
    return _reach(spark, d).withColumns({"at": F.col("at").cast("int"), "reach": F.col("reach").cast("int")})


@query(f"""WITH {REACH}, n AS (SELECT map_id, count(*) AS n FROM nodes GROUP BY 1), w AS (SELECT re.*, abs(reach) / n AS w, stands / n AS p FROM re JOIN n USING (map_id)),
v AS (SELECT map_id, sum(p * w) / sum(w) AS centre, (sum(CASE WHEN reach > 0 THEN w ELSE 0 END) - sum(CASE WHEN reach > 0 THEN 0 ELSE w END)) / sum(w) AS lean FROM w GROUP BY 1)
SELECT map_id, round(centre, 9) AS centre, round(lean, 9) AS lean, CASE WHEN centre > 0.62 THEN 'late' WHEN centre < 0.42 THEN 'early' ELSE 'throughout' END AS settles FROM v""")
def reason_verdict(spark, d):
    sizes = _nodes(spark, d).groupBy("map_id").agg(F.count("*").alias("n"))
    return positions.verdict(_reach(spark, d), sizes).withColumns({"centre": F.round("centre", 9), "lean": F.round("lean", 9)})


@query(f"WITH {REACH} SELECT map_id, min(stands)::INT AS first, max(stands)::INT AS last FROM re GROUP BY 1")
def reason_extent(spark, d):
    return positions.extent(_reach(spark, d)).select("map_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query(f"WITH {POS} SELECT map_id, CASE WHEN grouping(band) = 1 THEN NULL ELSE band END AS band, count(*) AS nodes, count(pos) AS placed FROM (SELECT *, (pos // 200)::INT AS band FROM nodes) GROUP BY GROUPING SETS ((map_id, band), (map_id))")
def band_profile(spark, d):
    return positions.by_band(_nodes(spark, d).withColumn("band", F.floor(F.col("pos") / 200).cast("int")))


@query("""WITH c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, greatest(8, least(24, floor(n / 4 + 0.5)))::INT AS bins, greatest(3, floor(n * 0.08 + 0.5))::INT AS named, round(least(1.0, pow(n / 5000, 0.55)), 9) AS loud FROM c""")
def profile_scales(spark, d):
    n = F.col("n")
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return c.select("k", positions.bin_count(n).alias("bins"), positions.significant(n).alias("named"), F.round(positions.amplified(n, F.lit(5000)), 9).alias("loud"))


@query("""SELECT l_partkey AS quote_id, l_orderkey * 10 + l_linenumber AS line FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R', l_linestatus = 'F' DESC, l_tax >= 0.04, l_orderkey * 10 + l_linenumber) = 1""")
def choose_occurrence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("quote_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_returnflag") == "R").alias("front"), (F.col("l_linestatus") == "F").alias("pinned"), (F.col("l_tax") >= 0.04).alias("abstract"))
    return positions.occurrence(rows)


@query(r"SELECT doc_id, list_distinct(regexp_extract_all(text, '\b(?:TABLE|Table|table)\s+((?:\d{1,2}|[IVX]{1,4})(?:\.\d+)?)\b', 1)).len()::INT AS labels FROM documents WHERE text IS NOT NULL")
def table_signal(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(positions.table_labels(F.col("text"))).alias("labels"))


@query(f"""WITH {S}, {RELATIONS}, c AS (SELECT map_id, least(a, b) AS x, greatest(a, b) AS y FROM rel WHERE kind = 'attack' AND a <> b), named AS (SELECT DISTINCT map_id, 'set ' || regime AS name, title AS node FROM s WHERE src = 'n0' AND dst = 'n0'),
held AS (SELECT DISTINCT p.map_id, p.node AS x, q.node AS y FROM named p JOIN named q USING (map_id, name))
SELECT map_id, name, string_agg(node, ',' ORDER BY node) AS members FROM named GROUP BY 1, 2 UNION ALL
SELECT DISTINCT map_id, NULL, x || ',' || y FROM c WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.map_id = c.map_id AND held.x = c.x AND held.y = c.y)""")
def inconsistent_sets(spark, d):
    steps = _steps(spark, d)
    named = steps.filter("src = 'n0' AND dst = 'n0'").select("map_id", F.concat(F.lit("set "), "regime").alias("name"), F.col("title").alias("node")).distinct()
    edges = _relations(steps).filter("kind = 'attack'").select("map_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("contradictory").alias("kind"))
    return positions.inconsistent(named, edges).withColumn("members", joined("members"))


@query(f"WITH {S}, {STATES} SELECT DISTINCT a.map_id, a.layer, a.src AS state FROM s a JOIN s b ON a.map_id = b.map_id AND a.layer = b.layer AND a.src = b.dst WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.map_id = a.map_id AND x.id = a.src AND role IS NOT NULL)")
def chain_foldable(spark, d):
    steps = _steps(spark, d)
    return positions.foldable(steps, _states(steps))


@query(f"""WITH {S}, t AS (SELECT DISTINCT map_id, layer, src, dst, sign, CASE WHEN layer = 'appraisal' THEN 3 WHEN basis IN ('study', 'statistics', 'model') THEN 0 WHEN basis IN ('example', 'testimony') THEN 1 ELSE 2 END AS tier FROM s),
kept AS (SELECT * FROM t WHERE src <> 'n4' AND dst <> 'n4'), made AS (SELECT a.map_id, a.layer, a.src, b.dst, CASE WHEN a.sign IN ('+', '-') AND b.sign IN ('+', '-') THEN CASE WHEN a.sign = b.sign THEN '+' ELSE '-' END ELSE '?' END AS sign, greatest(a.tier, b.tier) AS tier
 FROM t a JOIN t b ON a.map_id = b.map_id AND a.layer = b.layer AND a.dst = 'n4' AND b.src = 'n4' WHERE a.src <> b.dst AND a.src <> 'n4' AND b.dst <> 'n4')
SELECT map_id, layer, src, dst, sign, min(tier)::INT AS tier FROM (SELECT * FROM kept UNION ALL SELECT * FROM made) GROUP BY ALL""")
def fold_state(spark, d):
    steps = _steps(spark, d)
    rows = steps.withColumn("tier", profile.tier_rank(F.col("basis"), F.col("layer")))
    return positions.folded(rows, steps.select("map_id", F.lit("n4").alias("state")).distinct())


@query(f"""WITH RECURSIVE {S}, {RELATIONS}, e AS (SELECT DISTINCT map_id, a AS src, b AS dst FROM rel WHERE substring(a, 2)::INT > substring(b, 2)::INT), apex AS (SELECT DISTINCT map_id, dst AS node FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.map_id = x.map_id AND y.src = x.dst)),
r AS (SELECT map_id, node, 0 AS depth FROM apex UNION SELECT r.map_id, e.src, r.depth + 1 FROM r JOIN e ON e.map_id = r.map_id AND e.dst = r.node WHERE r.depth < 41) SELECT map_id, node, min(depth)::INT AS depth FROM r GROUP BY ALL""")
def claim_depths(spark, d):
    node = lambda c: F.struct("map_id", F.col(c).alias("t"))
    e = _relations(_steps(spark, d)).filter(F.substring("a", 2, 9).cast("int") > F.substring("b", 2, 9).cast("int")).select("map_id", node("a").alias("src"), node("b").alias("dst")).distinct()
    apex = e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return positions.depths(e, apex).select("node.map_id", F.col("node.t").alias("node"), "depth")


@query(f"WITH {S} SELECT DISTINCT map_id, title, \"on\" AS key FROM s WHERE \"on\" NOT IN ('being', 'level')")
def unknown_keys(spark, d):
    data = _steps(spark, d).select("map_id", "title", F.create_map("on", F.lit("x")).alias("data"))
    return positions.unknown_keys(data, ["being", "level"])


@query(f"WITH {S} SELECT map_id, nullif(design, '') AS warrant, count(*) AS n FROM s WHERE layer = 'appraisal' GROUP BY ALL")
def warrant_census(spark, d):
    claims = _steps(spark, d).select("map_id", F.when(F.col("layer") == "appraisal", "imputed").otherwise("quotation").alias("fidelity"), F.col("design").alias("warrant"))
    return positions.warrants(claims)


@query("""SELECT p_partkey, '"' || replace(replace(p_name, '\\', '\\\\'), '"', '\\"') || '"' AS quoted FROM part""")
def yaml_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", positions.yaml_string(F.col("p_name")).alias("quoted"))


@query()
def map_fingerprints(spark, d):
    """One FNV-1a fingerprint per priority's claims and relations. Rows only; the hash is held against its definition in the tests."""
    steps = _steps(spark, d)
    edges = _relations(steps).select("map_id", F.col("a").alias("src"), F.col("b").alias("dst"), "kind")
    return positions.fingerprint(_nodes(spark, d).select("map_id", "node"), edges)


# ---------------------------------------------------------------- bridges
QUESTIONS = [(f"q{k}", asks) for k, asks in enumerate((*bridges.PROBES, None, "taste"))]


def _bridged(steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eight bridges a map, each by the steps of five claims; claims are of the text or its rivals."""
    n = F.substring("title", 2, 9).cast("int")
    premises = steps.select("map_id", F.concat(F.lit("b"), (n % 8).cast("string")).alias("arg"), "title").distinct()
    k = F.substring("id", 2, 9).cast("int")
    states = _states(steps).select("map_id", "id", "role", F.when(k % 2 == 0, F.concat(F.lit("k"), (k % 4).cast("string"))).alias("kind"), F.when(k % 5 == 0, "possible").when(k % 5 == 1, "open").alias("status"))
    return premises, steps.withColumn("threshold", F.col("size")).withColumn("measured_by", F.col("jointly")), states


def _quoted(c: str) -> str:
    return f"'“' || {c} || '”'"


_FORMED = " ".join(f"WHEN \"on\" = '{on}' AND sign = '{sign}' THEN '{word}'" for on, words in bridges.FORMATION.items() for sign, word in zip("+-", words, strict=True))
_VERB = f"""CASE WHEN nul THEN 'no effect' WHEN selects THEN 'selection effect' WHEN assoc THEN 'associated' WHEN "on" = 'character' AND coalesce(sign, '') <> '' THEN 'transforms' {_FORMED}
 WHEN "on" = 'trend' AND sign IN ('+', '-') THEN CASE sign WHEN '+' THEN 'speeds' ELSE 'slows' END WHEN necessary AND sufficient THEN 'needed and enough for' WHEN necessary THEN 'needed for' WHEN sufficient THEN 'enough for'
 {" ".join(f"WHEN coalesce(sign, '') = '{k}' THEN '{w}'" for k, w in bridges.VERBS.items())} ELSE sign END"""


def _item(asks: str, said: str, rest: str) -> str:
    return f"SELECT DISTINCT map_id, arg, '{asks}' AS asks, {said} AS said FROM {rest}"


_NOT_OWN = "NOT EXISTS (SELECT 1 FROM premises p WHERE p.map_id = z.map_id AND p.arg = z.arg AND p.title = z.title)"
_NO_FROM = lambda c: f"NOT EXISTS (SELECT 1 FROM froms f WHERE f.map_id = z.map_id AND f.arg = z.arg AND f.state = z.{c})"
_NO_TO = "NOT EXISTS (SELECT 1 FROM tos t WHERE t.map_id = z.map_id AND t.arg = z.arg AND t.state = z.dst)"
_SCOPED = "said || ': ' || CASE scope WHEN 'singular' THEN 'a single case' ELSE 'a general relation' END"
_PROBES = [
    *(_item(a, "said || ' unless ' || " + _quoted("blocker"), "premised WHERE blocker IS NOT NULL") for a in ("counter", "blockers")),
    *(_item(a, "said || ', regime: ' || regime", "premised WHERE regime <> ''") for a in ("counter", "mediated", "scope")),
    *(_item(a, "said || ' past a threshold: ' || size", "premised WHERE size <> ''") for a in ("counter", "mediated")),
    _item("counter", "'a view the text reports: ' || said", f"arriving z WHERE layer = 'rival' AND {_NOT_OWN}"),
    _item("counter", "said", f"arriving z WHERE layer = 'text' AND (sign = '-' AND rises OR sign = '+' AND falls) AND {_NOT_OWN} AND {_NO_FROM('src')}"),
    _item("rivals", "said || CASE WHEN stance IS NOT NULL THEN ' (' || stance || ')' ELSE '' END", "voiced s JOIN (SELECT map_id, arg, state FROM froms UNION SELECT map_id, arg, state FROM tos) e USING (map_id) WHERE layer = 'rival' AND dst = state"),
    _item("otherroutes", "said", f"arriving z WHERE layer = 'text' AND NOT nul AND NOT assoc AND NOT selects AND {_NOT_OWN} AND {_NO_FROM('src')}"),
    _item("elsewhere", "said", "onward"),
    _item("goals", "said", "onward WHERE outcome"),
    _item("sideeffects", "said", "onward WHERE NOT outcome"),
    _item("blockers", "said || ' unless ' || " + _quoted("blocker"), f"leaving z WHERE layer = 'text' AND blocker IS NOT NULL AND {_NOT_OWN}"),
    _item("common", f"{_quoted('x.src')} || ' leads to both ' || {_quoted('o.src')} || ' and ' || {_quoted('o.dst')}", "(SELECT DISTINCT map_id, arg, src, dst FROM premised) o JOIN told x USING (map_id) JOIN told y USING (map_id) WHERE x.dst = o.src AND y.dst = o.dst AND x.src = y.src AND x.src <> o.src AND x.src <> o.dst"),
    _item("reverse", "b.said || ' as well'", "(SELECT DISTINCT map_id, arg, src, dst FROM premised) o JOIN (SELECT map_id, src AS b_src, dst AS b_dst, min(said) AS said FROM voiced GROUP BY 1, 2, 3) b USING (map_id) WHERE b_src = o.dst AND b_dst = o.src"),
    "SELECT map_id, arg, 'backing' AS asks, ['tested', 'argued for', 'asserted', 'imputed by the reconstructor'][k + 1] || ': ' || count(*) || CASE k WHEN 0 THEN ' (' || string_agg(DISTINCT basis, ', ' ORDER BY basis) || ')' ELSE '' END AS said FROM ranked GROUP BY map_id, arg, k",
    _item("mediated", "said || ' through ' || " + _quoted("through"), "premised WHERE through IS NOT NULL"),
    *(_item(a, "said || ': ' || period", "premised WHERE period <> ''") for a in ("mediated", "scope")),
    *(_item(a, _SCOPED, "premised WHERE scope <> ''") for a in ("mediated", "scope")),
    _item("measure", "said || ', read from ' || " + _quoted("also"), "premised WHERE also IS NOT NULL"),
    _item("kinds", f"{_quoted('id')} || ' is of the kind ' || {_quoted('kind')}", "described WHERE kind IS NOT NULL"),
    _item("possible", f"{_quoted('id')} || CASE status WHEN 'open' THEN ' cannot be specified in advance, the text says' ELSE ' is a possibility the text sets out' END", "described WHERE status IS NOT NULL"),
    "SELECT map_id, arg, 'howmany', count(*) || ' steps' || CASE WHEN count(nullif(regime, '')) > 0 THEN ', in ' || count(DISTINCT nullif(regime, '')) || ' settings: ' || string_agg(DISTINCT nullif(regime, ''), '; ' ORDER BY nullif(regime, '')) ELSE '' END FROM premised GROUP BY 1, 2",
    "SELECT map_id, arg, 'route', string_agg(DISTINCT said, '; ' ORDER BY said) FROM premised GROUP BY 1, 2",
    _item("onecase", "said || ' is about a single case'", "premised WHERE scope = 'singular'"),
    _item("support", "said || ' only together with ' || " + _quoted("also"), "premised WHERE also IS NOT NULL"),
    *(_item(a, "said || ' given ' || condition", "premised WHERE condition <> ''") for a in ("support", "scope")),
    "SELECT t.map_id, t.arg, 'stops', coalesce('the chain goes on to ' || string_agg(DISTINCT '“' || r.state || '”', ', ' ORDER BY '“' || r.state || '”') FILTER (NOT EXISTS (SELECT 1 FROM told x WHERE x.map_id = r.map_id AND x.src = r.state AND x.dst <> x.src)) || ', and stops there', 'the chain closes on itself: every state it reaches leads on') FROM tos t JOIN reached r USING (map_id, arg) GROUP BY 1, 2",
]


@query(f"""WITH RECURSIVE {S}, {STATES}, voiced AS (SELECT *, CASE WHEN v IN ('no effect', 'selection effect', 'associated') THEN {_quoted('src')} || ' → ' || {_quoted('dst')} || ': ' || v ELSE {_quoted('src')} || ' ' || v || ' ' || {_quoted('dst')} END AS said FROM (SELECT *, {_VERB} AS v FROM s)),
premises AS (SELECT DISTINCT map_id, 'b' || (substring(title, 2)::INT % 8) AS arg, title FROM s), premised AS (SELECT * FROM voiced JOIN premises USING (map_id, title)),
froms AS (SELECT DISTINCT map_id, arg, src AS state FROM premised), tos AS (SELECT map_id, arg, dst AS state, bool_or(sign = '+') AS rises, bool_or(sign = '-') AS falls FROM premised GROUP BY 1, 2, 3),
told AS (SELECT DISTINCT map_id, src, dst FROM voiced WHERE layer = 'text' AND NOT nul AND NOT assoc AND NOT selects),
arriving AS (SELECT s.*, t.arg, rises, falls FROM voiced s JOIN tos t ON t.map_id = s.map_id AND t.state = s.dst), leaving AS (SELECT s.*, f.arg FROM voiced s JOIN froms f ON f.map_id = s.map_id AND f.state = s.src),
onward AS (SELECT z.*, coalesce(x.role = 'outcome', false) AS outcome FROM leaving z LEFT JOIN states x ON x.map_id = z.map_id AND x.id = z.dst WHERE layer = 'text' AND NOT nul AND NOT assoc AND NOT selects AND {_NOT_OWN} AND {_NO_TO}),
ranked AS (SELECT *, CASE WHEN layer = 'appraisal' THEN 3 WHEN basis IN ('study', 'statistics', 'model') THEN 0 WHEN basis IN ('example', 'testimony') THEN 1 ELSE 2 END AS k FROM premised),
described AS (SELECT e.map_id, e.arg, x.id, CASE WHEN substring(id, 2)::INT % 2 = 0 THEN 'k' || (substring(id, 2)::INT % 4) END AS kind, CASE substring(id, 2)::INT % 5 WHEN 0 THEN 'possible' WHEN 1 THEN 'open' END AS status
  FROM (SELECT map_id, arg, state FROM froms UNION SELECT map_id, arg, state FROM tos) e JOIN states x ON x.map_id = e.map_id AND x.id = e.state),
reached AS (SELECT map_id, arg, state FROM tos UNION SELECT r.map_id, r.arg, x.dst FROM reached r JOIN told x ON x.map_id = r.map_id AND x.src = r.state),
items AS ({" UNION ".join(_PROBES)}),
found AS (SELECT map_id, arg, asks, count(*) AS n, string_agg(said, ' | ' ORDER BY said) AS said FROM items GROUP BY 1, 2, 3),
asked AS (SELECT * FROM (VALUES {", ".join(f"('{q}', {repr(a) if a else 'NULL'})" for q, a in QUESTIONS)}) AS q(question, asks)),
known AS (SELECT *, coalesce(asks IN ({", ".join(repr(a) for a in bridges.PROBES)}), false) AS known FROM asked)
SELECT b.map_id, b.arg, question, CASE WHEN known THEN k.asks END AS asks, CASE WHEN NOT known THEN 'reader' WHEN n > 0 THEN 'recorded' ELSE 'none' END AS status, coalesce(n, 0) AS n, coalesce(said, '') AS said
FROM (SELECT DISTINCT map_id, arg FROM premises) b CROSS JOIN known k LEFT JOIN found f ON f.map_id = b.map_id AND f.arg = b.arg AND f.asks = k.asks""")
def bridge_questions(spark, d):
    questions = spark.createDataFrame(QUESTIONS, "question string, asks string")
    premises, steps, states = _bridged(_steps(spark, d))
    return bridges.bridge_questions(premises, questions, steps, states)
