import random
import re
from collections import Counter

from enthyme.llm.decontaminate import BLOCKS, FLIPS, RADIUS, contaminated


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def runs(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v:
                continue
            k, best = min(5, len(v)), 0.0
            b = runs(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = runs(w[s : s + len(v)], k)
                both, either = sum((a & b).values()), sum((a | b).values())
                if both and 5 * both >= 4 * either:
                    best = max(best, both / either)
            if best:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_the_index_holds_all_within_the_radius():
    assert sum(w for _, w in BLOCKS) == 64 and RADIUS // len(BLOCKS) <= FLIPS


def test_leaks_against_brute_force(documents, spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(500)] + ["das", "élan", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 38, 60])))) for i in range(30)] + [(90, None), (91, "..."), (92, "ab ab ab ab ab ab ab ab"), (93, items_twin := "one two three four five six")]
    docs = []
    for d in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 80)))]
        if d % 2:
            w = rng.choice(items[:30])[1].split()
            if d % 4 == 1 and len(w) > 10:
                w[rng.choice([0, len(w) - 1, len(w) // 2])] = "edited"
            parts += [", ".join(w).upper() if d % 3 else "\n".join(w), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "ab " * 30_000), (503, items_twin), (503, "nothing"), (None, items_twin)]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, n string, k int")
    got = contaminated(documents(docs), bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) and len(want) > 40
    assert contaminated(documents([]), bench).collect() == [] and contaminated(documents(docs), bench.limit(0)).collect() == []


def test_inserted_and_omitted_words(documents, spark):
    """Recall at the radius, by length of item: items with words inserted, left out, moved and changed, the best windows among them."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(900)]
    sizes = [6, 12, 25, 50, 80, 120, 200]
    items = [(i, " ".join(rng.choices(vocabulary, k=sizes[i % 7]))) for i in range(35)]
    docs = []
    for d in range(210):
        w = items[d % 35][1].split()
        for _ in range(rng.randrange(1, 2 + len(w) // 40)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at:at] = rng.choices(vocabulary, k=rng.randrange(1, 2 + len(w) // 30))
            elif kind == 1:
                del w[at : at + rng.randrange(1, 2 + len(w) // 30)]
            else:
                w[at] = rng.choice(vocabulary)
        edge = lambda: rng.choices(vocabulary, k=rng.choice([0, 1, 3, 40]))
        docs.append((d, " ".join(edge() + w + edge())))
    want = {k: v for x in docs for k, v in brute([x], [items[x[0] % 35]]).items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n in sizes:
        pairs = [k for k in want if sizes[k[1] % 7] == n]
        assert pairs or n < 25
        assert sum(k in got for k in pairs) >= 0.99 * len(pairs)
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
