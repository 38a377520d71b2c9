"""Splices against sequence comparison in plain Python."""

import random
from difflib import SequenceMatcher

from enthyme.operators.splices import GAP, RUN, SHARE, SHOWN, spliced


def brute(claim, body):
    if body is None or claim is None or len(claim) < 2 * RUN or "..." in claim:
        return None
    blocks = [b for b in SequenceMatcher(None, claim, body, autojunk=False).get_matching_blocks() if b.size >= RUN]
    if sum(b.size for b in blocks) < SHARE * len(claim):
        return None
    for a, b in zip(blocks, blocks[1:]):
        gap = b.b - a.b - a.size
        if gap >= GAP:
            return gap, claim[a.a : a.a + a.size][-SHOWN:], claim[b.a : b.a + b.size][:SHOWN]
    return None


def test_against_sequence_comparison(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choices("abcdeé日", k=rng.randrange(2, 9))) for _ in range(n))
    claims, sources = [], []
    for i in range(80):
        parts = [say(rng.randrange(8, 40)) for _ in range(6)]
        if i % 7 == 0:
            parts[4] = parts[1]  # a passage that stands twice
        body = " ".join(parts)
        cut = lambda p: p[rng.randrange(0, 9) : len(p) - rng.randrange(0, 9)].strip()
        chosen = [cut(parts[k]) for k in (rng.sample(range(6), 2) if i % 3 else (0, 5))]
        claim = (" and " if i % 2 else " ").join(chosen) + (" " + say(rng.randrange(0, 12)))
        if i % 5 == 0:
            claim = claim[:50] + "x" + claim[51:]
        claims.append((i, i, claim.strip(), None))
        sources.append((i, body))
    same = "the same forty characters and more of them, "
    sources += [(100, same * 9 + say(60) + same * 2), (101, None), (102, ""), (103, say(90))]
    claims += [(100, 100, (same * 4).strip(), None), (101, 101, "x" * 100, None), (102, 102, "x" * 100, None), (103, 103, None, None), (104, 0, claims[0][2][:50] + " ... " + claims[0][2][50:], None), (105, 3, claims[3][2], "joined"), (106, 999, "y" * 90, None)]
    df = spark.createDataFrame(claims, "claim_id long, source_id long, text string, note string")
    got = {r.claim_id: (r.gap, r.left, r.right) for r in spliced(df, spark.createDataFrame(sources, "source_id long, text string")).collect()}
    bodies = dict(sources)
    want = {c: b for c, s, t, note in claims if note is None and (b := brute(t, bodies.get(s)))}
    assert got == want and len(want) > 15
    assert spliced(df.limit(0), spark.createDataFrame(sources, "source_id long, text string")).collect() == []
