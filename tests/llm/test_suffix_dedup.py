import hashlib
import random

import numpy as np
import pytest

from enthyme.llm.suffix_dedup import common_prefixes, suffix_array, without_repeats, words_at


def brute(rows, length):
    """By every string of every document: the first id that has it, and the first start in each row."""
    read = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in read:
        for s in range(len(b) - length + 1 if i is not None else 0):
            k = b[s : s + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in read:
        gone, seen = np.zeros(len(b), dtype=bool), set()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen or (i is not None and first[k] < i):
                gone[s : s + length] = True
            seen.add(k)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, length, n):
    rng = random.Random(seed)
    letters = "abcdefgh \né日𐐀\x00"
    say = lambda k: "".join(rng.choices(letters, k=k))
    passages = [say(rng.randrange(length // 2, 3 * length)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else say(rng.randrange(1, length))
            if rng.random() < 0.3:
                x = rng.randrange(len(p))
                p = p[:x] + "X" + p[x + 1 :]
            parts.append(p[rng.randrange(0, 4) :])
        texts.append("".join(parts))
    texts += texts[:8] + ["ab" * 400, "ab" * 300, "z" * 500, "z" * (length - 1), "z" * length, None, "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[5]), (3, texts[5]), (None, texts[5]), (None, texts[6] + texts[6])]


@pytest.mark.parametrize(
    ("length", "seed", "options"),
    [(100, 1, {}), (100, 2, {"shard": 1500}), (40, 3, {"shard": 700, "gram": 16, "bucket_bytes": 2000}), (30, 4, {"shard": 300, "gram": 8, "most": 3, "bucket_bytes": 5000}), (24, 5, {"shard": 400, "gram": 24, "most": 2}), (40, 6, {"gram": 20, "packed_bits": 4})],
)
def test_removal_against_brute_force(documents, length, seed, options):
    rows = corpus(seed, length, 90)
    got = without_repeats(documents(rows).repartition(3), length=length, **options)
    assert found(got) == brute(rows, length)


def test_order_and_prefixes():
    rng = random.Random(9)
    for trial in range(30):
        docs = ["".join(rng.choices("ab" if trial % 2 else "abcdefghé", k=rng.randrange(1, 60))).encode() for _ in range(rng.randrange(1, 12))]
        docs += docs[:3] + [b"a" * 1200, b"a" * 900]
        data = np.frombuffer(b"".join(d + b"\xff" for d in docs), dtype=np.uint8)
        ends = np.flatnonzero(data == 255)
        last = ends[np.searchsorted(ends, np.arange(len(data)))]
        order = suffix_array(data, last, 21 if trial % 3 else 2)
        raw = data.tobytes()
        keys = [(raw[i : last[i]] + b"\xff", i) for i in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(data)))
        shared = common_prefixes(data, words_at(data), order, last)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            x, y = raw[a : last[a]], raw[b : last[b]]
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert shared[b] == n


def test_long_and_empty(documents):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghij ", k=300_000))
    rows = [(2, long), (1, long[5000:5400]), (4, "x" + long), (3, "y" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, len(r.kept)) for r in without_repeats(documents(rows)).collect()}
    assert got == {1: (400, 0, 0, 400), 2: (300_000, 400, 1, 299_600), 3: (200, 199, 1, 1), 4: (300_001, 300_000, 1, 1)}
    assert without_repeats(documents([])).collect() == []
