import random
import re

from enthyme.llm.license_scan import PASSAGES, PHRASES, licence_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_places_against_brute_force(documents):
    rng = random.Random(3)
    vocabulary = ["gnu", "General", "PUBLIC", "license", "apache", "mit", "cc", "by", "é", "x1", "the"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "MIT License " * 20_000), (1002, "MIT License"), (None, "cc-by")]
    got = licence_scan(documents(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(map(str, ((i, *base(t)) for i, t in rows)))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    assert licence_scan(documents([])).collect() == []


def test_passages_are_found_with_small_changes(documents):
    rows = [(k, "some words before. " + p[3].capitalize() + ", and after") for k, p in enumerate(PASSAGES)]
    near = PASSAGES[0][3].replace("associated ", "").replace("restriction", "limit")
    rows += [(50, near), (51, "permission is hereby granted"), (52, " ".join(reversed(PASSAGES[0][3].split())))]
    got = {r.doc_id: r.labels.split(",") for r in licence_scan(documents(rows)).collect()}
    for k, (_, label, _, _) in enumerate(PASSAGES):
        assert label in got[k], PASSAGES[k][0]
    assert "mit" in got[50] and got[51] == [""] and got[52] == [""]
