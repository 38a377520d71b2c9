"""What must hold whatever the size of a table: counts without listing, the same results by the shorter way."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from enthyme.functions import cleaning, similar, text
from enthyme.operators import coverage, frames, graph, lines, quotes, suppose
from enthyme.plans import catalog


def test_differences_are_counted_without_listing_the_pairs(spark):
    rng = random.Random(1)
    cells = [(i, f, rng.choice(v)) for i in range(120) for f, v in (("x", "abc"), ("y", "ab"), ("z", "abcd")) if rng.random() < 0.95]
    cells += [(i, "v", rng.choice(["yes", "no", "open", "impossible"])) for i in range(120) if i % 4]
    cells += [(7, "x", "b"), (8, "v", "no")]
    df = spark.createDataFrame(cells, "case_id long, frame string, value string")
    pairs = frames.differing_in_one(df, ["x", "y", "z"], "v").collect()
    n, apart = Counter(r.dimension for r in pairs), Counter(r.dimension for r in pairs if r.verdict_a and r.verdict_b and r.verdict_a != r.verdict_b)
    got = {(r.dimension, r.pairs, r.apart) for r in frames.difference_counts(df, ["x", "y", "z"], "v").collect()}
    assert got == {(d, n[d], apart[d]) for d in n} and len(got) == 3
    assert frames.difference_counts(df.limit(0), ["x", "y"], "v").collect() == []
    # ten billion pairs and more, and no verdicts
    many = spark.range(300_000).select(F.col("id").alias("case_id"), F.explode(F.create_map(F.lit("x"), (F.col("id") % 2).cast("string"), F.lit("y"), F.lit("same"))).alias("frame", "value"))
    assert [tuple(r) for r in frames.difference_counts(many, ["x", "y"], "v").collect()] == [("x", 150_000**2, 0)]


def test_word_boundaries_are_those_of_the_sql(spark):
    said = ["yóc d f ggg", "él c d f g", "añd f g h í", "x\x0by z", "words b c d here", "cañcaused in turn éeffects of", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id int, text string").coalesce(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en')", list(enumerate(said)))
    got = df.select("doc_id", cleaning.quality(F.col("text")).alias("quality")).collect()
    assert {tuple(r) for r in got} == set(con.execute(catalog.ORACLE_SQL["conversion_quality"]).fetchall())
    mentions = con.execute(catalog.ORACLE_SQL["causal_signal"]).fetchall()[0][2]
    assert df.agg(F.sum(text.causal_mentions(F.col("text")))).first()[0] == mentions == 3


def test_suppositions_by_what_they_change(spark):
    rng = random.Random(3)
    args = [(f"a{k}", rng.randrange(14)) for k in range(20)] + [("free", 13)]
    ins = [(f"a{k}", rng.randrange(14)) for k in range(20) for _ in range(rng.randrange(1, 3))]
    ins += ins[:5] + [("a3", 99), ("none", 1)]
    basic = set(range(14)) - {c for _, c in args}
    said = {(f"s{k}", i, rng.random() < 0.4) for k in range(25) for i in rng.sample(range(14), 3) if i not in basic or k % 2}
    said |= {(f"s{k}", i, False) for k in range(25) for i in sorted(basic)[:1 + k % 3]}
    cuts = {(f"s{k}", f"a{rng.randrange(20)}") for k in range(0, 25, 3)}

    def brute(said, cuts):
        now = {i for i in basic if (i, False) not in said} | {i for i, h in said if h}
        while True:
            new = {c for a, c in args if a not in cuts and all(i in now for b, i in ins if b == a) and (c, False) not in said} - now
            if not new:
                return now
            now |= new

    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema).coalesce(1)
    tables = frame([(i,) for i in range(14)], "id int"), frame(args, "arg string, concludes int"), frame(ins, "arg string, input int")
    sup, cut = frame(said, "scenario string, id int, holds boolean"), frame(cuts, "scenario string, arg string")
    want = {(s, i) for s in {x[0] for x in said} for i in brute({(i, h) for t, i, h in said if t == s}, {a for t, a in cuts if t == s})}
    assert {tuple(r) for r in suppose.holding(*tables, sup, sup.select("scenario"), cut).collect()} == want
    failing = {(s, i) for s in {x[0] for x in said if not x[2]} for i in range(14)} - want - {(s, i) for s, i, h in said if not h}
    assert {tuple(r) for r in suppose.not_holding(*tables, sup, cut).collect()} == failing and failing


def test_pieces_of_chains_hubs_and_loops(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = [*chain, *((200, 300 + i) for i in range(50)), (7, 7), (8, 9), (9, 8), (9, 9)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(edges, "src long, dst long").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted(root.items())
    names = spark.createDataFrame([("c10", "p1"), ("c9", "p1"), ("c9", "p2"), ("x", "y")], "src string, dst string").coalesce(1)
    assert {tuple(r) for r in graph.components(names).collect()} == {(n, "c10") for n in ("c10", "c9", "p1", "p2")} | {("x", "x"), ("y", "x")}


def test_paragraphs_below_the_least_are_no_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(60)]
    claims = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(30, None), (31, "")]
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=25)) for _ in range(5))) for i in range(20)] + [(20, None)]
    want, best = {}, {}
    for c, t in claims:
        for d, body in docs:
            for k, p in enumerate((body or "").split("\n"), 1):
                said = (t or "").split()
                score = sum(w in p.split() for w in said) / len(said) if said and len(p) >= 120 else 0
                if score >= 0.6:
                    want[c, d, k] = score
                if score >= 0.3:
                    best[c] = min(best.get(c, (0, 0, 0)), (-score, d, k))
    q, s = spark.createDataFrame(claims, "item_id int, text string").coalesce(1), spark.createDataFrame(docs, "doc_id int, text string").coalesce(1)
    for block, dense in ((200_000, 4_000_000), (40, 7)):
        monkeypatch.setattr(quotes, "BLOCK_WORDS", block)
        monkeypatch.setattr(quotes, "DENSE", dense)
        rows = quotes.scored(q, s, "item_id", "doc_id", "text", 0.6)
        assert {(r.claim_id, r.source_id, r.line): r.score for r in rows.collect()} == want and want
    assert {r.claim_id: (-r.score, r.source_id, r.line) for r in quotes.best_paragraph(q, s).collect()} == best


def test_common_gives_up_when_it_is_sure(spark):
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd é", k=rng.randrange(0, 70))) for _ in range(2))
        full, need = similar.common(a, b), rng.randrange(0, 60)
        assert similar.common(a, b, similar.places_of(a), need) in ({full} if full >= need else {full, -1})
    assert similar.common("a" * 64, "b" * 64, need=48) == -1


def test_sentences_of_a_long_paragraph(spark):
    body = " ".join(f"Sentence number {i} says that much of it." for i in range(20_000))
    docs = spark.createDataFrame([(1, body), (2, "One two three four that five. Six\n\nSeven eight that nine ten eleven.")], "source_id int, text string").coalesce(1)
    found = coverage.sentences(docs, lines.source_lines(docs, "source_id")).collect()
    assert len(found) == 20_002 and all(body[r.begin - 1 : r.end - 1] == r.sentence for r in found if r.source_id == 1)
    assert {(r.line, r.next_line, r.begin) for r in found if r.source_id == 2} == {(1, 3, 1), (3, None, 35)}
