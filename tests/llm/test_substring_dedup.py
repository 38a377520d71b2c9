import hashlib
import random

import pytest

from enthyme.llm.substring_dedup import without_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "bucket", "seed"), [(50, 8_000_000, 1), (50, 3_000, 2), (12, 2_000, 3)])
def test_removal_against_brute_force(documents, window, bucket, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "\xa0", "𐐀"]
    passages = [rng.choices(vocabulary, k=rng.randrange(window - 3, 4 * window)) for _ in range(8)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randrange(1, 80))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            w += part[rng.randrange(0, 5) :]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += texts[:10] + ["same " * 400, "same " * 300, "a b " * 200, None, "", "  "]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[5]), (None, texts[5])]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(documents(rows), window=window, bucket_bytes=bucket).collect())
    assert got == brute(rows, window)


def test_long_and_empty(documents):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(2, long), (1, " ".join(f"w{i}" for i in range(500, 700)))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(documents(rows)).collect()}
    assert got == {1: (200, 0), 2: (100_000, 200)}
    assert without_repeats(documents([])).collect() == []
