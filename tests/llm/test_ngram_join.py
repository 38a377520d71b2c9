import random

import pytest

from enthyme.llm import ngram_join
from enthyme.llm.components import smallest_reachable
from enthyme.llm.ngram_join import first_prefix, jaccard_components, one_of_each, second_prefix


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k, p, q):
    found = sets([r for r in rows if r[0] is not None], k)
    top = {i: i for i in found}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(found)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(u & v and q * len(u & v) >= p * len(u | v) for u in found[a] for v in found[b]):
                r, s = sorted((root(a), root(b)))
                top[s] = r
    return {i: root(i) for i in ids}


def family(rng, base, copies, edits, vocabulary):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, edits + 1)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                w[at] = rng.choice(vocabulary)
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, rng.choice(vocabulary))
            else:
                w = w[: max(3, len(w) - rng.randrange(8))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "p", "q", "seed"), [(3, 9, 10, 1), (5, 4, 5, 2), (3, 9, 10, 3), (2, 1, 2, 4)])
def test_components_against_brute_force(documents, k, p, q, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n in (12, 40, 90, 160):
        base = rng.choices(vocabulary, k=n)
        texts += family(rng, base, 40, 3 + n // 16, vocabulary)
    passage = " ".join(rng.choices(vocabulary, k=25))
    texts += [f"{' '.join(rng.choices(vocabulary, k=rng.randrange(1, 60)))} {passage} {' '.join(rng.choices(vocabulary, k=30))}" for _ in range(40)]
    texts += texts[:20] + ["one", "one", "ONE two", "", None, " \t ", "é è"]
    rng.shuffle(texts)
    rows = [(7 + 3 * i, t) for i, t in enumerate(texts)]
    want, known = brute(rows, k, p, q), sets(rows, k)
    got = {r.doc_id: r for r in jaccard_components(documents(rows), words=k, similarity=(p, q)).collect()}
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(known[i][0]) for i, r in got.items())


def alone(tag, count, n):
    """Pairs of a text of n words and the same without its last word; no two pairs share a word."""
    out = []
    for i in range(count):
        w = [f"{tag}{i}x{j}" for j in range(n)]
        out += [" ".join(w), " ".join(w[:-1])]
    return out


@pytest.mark.parametrize(("k", "p", "q", "n"), [(3, 9, 10, 12), (5, 4, 5, 9)])
def test_isolated_pairs_of_unlike_size(documents, k, p, q, n):
    rows = list(enumerate(alone("u", 60, n) + alone("v", 20, 3 * n)))
    want = brute(rows, k, p, q)
    assert all(want[i] == i - i % 2 for i in want)
    assert {r.doc_id: r.component_id for r in jaccard_components(documents(rows), words=k, similarity=(p, q)).collect()} == want


@pytest.mark.parametrize(("k", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_every_pair_of_sizes(documents, k, p, q):
    """Sets of 1 to 120 shingles, each with the smallest part of it that is similar: every pair is linked, and one shingle less never is."""
    rows, want = [], {}
    for n in range(1, 121):
        w = [f"s{n}x{j}" for j in range(n + k - 1)]
        least = -(-p * n // q)
        for i, m in enumerate((n, least, least - 1)):
            if m:
                rows.append((4 * n + i, " ".join(w[: m + k - 1])))
                want[4 * n + i] = 4 * n
    want |= {4 * n + 2: 4 * n + 2 for n in range(1, 121) if 4 * n + 2 in want and q * (-(-p * n // q) - 1) < p * -(-p * n // q)}
    assert {r.doc_id: r.component_id for r in jaccard_components(documents(rows), words=k, similarity=(p, q)).collect()} == want


def test_families_in_rounds_of_pivots(documents, monkeypatch):
    """One text with many variants of one to six edits, and strangers that share half of it: lists get pivots until few pairs are left."""
    monkeypatch.setattr(ngram_join, "FEW", 0)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    base = rng.choices(vocabulary, k=120)
    other = base[:60] + rng.choices(vocabulary, k=60)
    texts = family(rng, base, 120, 6, vocabulary) + family(rng, other, 60, 6, vocabulary)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(rows), words=5, similarity=(4, 5)).collect()}
    assert got == brute(rows, 5, 4, 5)


@pytest.mark.parametrize(("p", "q"), [(9, 10), (4, 5), (1, 2), (2, 3)])
def test_prefixes_are_long_enough(p, q):
    """The worst two sets there are: as few shared tokens as similarity allows, all of them behind the others under both orders."""
    for n in range(1, 120):
        for m in range(-(-p * n // q), n + 1):
            o = -(-p * (n + m) // (p + q))
            if o > m:
                continue
            a, b = first_prefix(n, p, q), first_prefix(m, p, q)
            both = min(o, a - (n - o), b - (m - o))
            assert both >= 1 and a - both < second_prefix(n, p, q) and b - both < second_prefix(m, p, q)


def test_odd_rows(documents):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "x y z u v w"), (5, "x y z u v w"), (None, "a b c d e f g"), (6, None), (7, ""), (8, "a " * 60_000)]
    df = documents(rows)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(0, 5, None), (1, 5, 1), (2, 4, 1), (2, 5, 1), (5, 4, 1), (6, 0, 6), (7, 0, 7), (8, 1, 8)]
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 6, 7, 8]
    assert jaccard_components(documents([])).collect() == []


def test_long_chains_contract(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(10, 5), (5, 7), (5, 5)]
    got = {r.node: r.component for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, 5: 5, 7: 5, 10: 5}
