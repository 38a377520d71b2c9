import math
import random
import re
from collections import Counter

from enthyme.llm.lexical_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k):
    read = [(i, Counter(terms(t))) for i, t in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    n_all, l_all = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in read:
            m = 100 - 50 + (50 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(spark, documents, docs, items, **options):
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS item")
    got = [tuple(r) for r in ranked(documents(docs).repartition(3), asked, **options).collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["é", "日本", "9", "Ünder"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    say = lambda k: " ,-\n"[rng.randrange(4)].join(rng.choices(vocabulary, weights, k=k))
    docs = [(i, say(rng.choice([1, 3, 20, 60, 400]))) for i in range(n)]
    docs += [(n + i, docs[0][1].upper()) for i in range(30)]  # ties
    docs += [(9000, None), (9001, ""), (9002, "...")] + [(9003, "w1 " * 20_000), (9003, "w1 w2"), (9003, "w1 w2"), (None, "w1 w2 w3")]
    items = [(i, say(rng.randrange(1, 40))) for i in range(25)] + [(100, docs[0][1]), (101, "nothing here"), (102, ""), (103, None), (3, "w7 w8 É"), (None, "w5 w6"), (None, "w9")]
    return docs, items


def test_against_brute_force(spark, documents):
    for seed, k, options in ((1, 50, {}), (2, 5, {"most_pairs": 60, "list_part": 40}), (3, 1, {"list_part": 7})):
        docs, items = corpus(seed, 400)
        assert found(spark, documents, docs, items, k=k, **options) == brute(docs, items, k)


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, "w1")]) == []
    assert found(spark, documents, [(1, "w1")], []) == []
    assert found(spark, documents, [(1, "other")], [(1, "w1")]) == []
    assert found(spark, documents, [(1, None), (2, "w1 w1")], [(1, "w1")]) == brute([(1, None), (2, "w1 w1")], [(1, "w1")], 50)
