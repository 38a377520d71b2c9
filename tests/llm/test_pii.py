import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from enthyme.llm import pii
from enthyme.llm.pii import KINDS, base_spans, personal_data, sanitised

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn(digits) or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text("a.@-1 209+()é%", max_size=60) | st.lists(st.sampled_from(["a@b.c", "x.y@", "@", "1.2.3.4", ".", "255.256.1.1", "4532015112830366", "4532 0151 1283 0366", "+1 (234) 555-1234", " ", "-", "é", "0000000001"]), max_size=8).map("".join))
def test_spans_are_the_patterns(text):
    assert [f"{k}:{s}:{e}" for s, e, k, _ in base_spans(text)] == plain(text)


def test_no_text_makes_the_patterns_slow():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1-" * 150_000, "+" * 300_000):
        base_spans(text)


def brute_terms(rows):
    """The terms that disclose an entity, by going through every window of every text in plain loops."""
    total, with_term, with_entity, with_both, near = 0, Counter(), Counter(), Counter(), {}
    for _, t in rows:
        t = t or ""
        spans = base_spans(t)
        tokens = [(s, kind, value) for s, _, kind, value in spans]
        tokens += [(m.start(), "", m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(s < m.end() and m.start() < e for s, e, _, _ in spans)]
        tokens = [(kind, value) for _, kind, value in sorted(tokens)]
        for start in range(-20, len(tokens)):
            window = set(tokens[max(0, start) : start + 21])
            total += 1
            terms, entities = {v for k, v in window if not k}, {x for x in window if x[0]}
            with_term.update(terms)
            with_entity.update(entities)
            with_both.update((e, w) for e in entities for w in terms)
        for e in {x for x in tokens if x[0]}:
            places = [k for k, x in enumerate(tokens) if x == e]
            around = tuple((k - places[0], x) for k, x in enumerate(tokens) if any(abs(k - p) <= 20 for p in places))
            near.setdefault(e, set()).add(around)
    out = {}
    for (e, w), n in with_both.items():
        support = sum(any(x == ("", w) for _, x in around) for around in near[e])
        information = math.log(total / with_entity[e])
        if support >= 3 and information > 0 and math.log(n * total / (with_term[w] * with_entity[e])) >= 0.8 * information:
            out[w] = n
    return out


def test_terms_are_marked_everywhere(documents, monkeypatch):
    """A disclosing term is a span far from the mention, and in texts without it; with lists of one term each too."""
    pad = " ".join(f"{w}{v}" for w in ("alpha", "gamma", "delta", "omega") for v in ("xa", "yb", "zc", "wd", "ve", "uf"))
    rows = [(i, f"{'uvwxyz'[i]}uno the {'uvwxyz'[i]}dos wizard bob@x.org mailed {'uvwxyz'[i]}tres {pad} {pad} Wizard") for i in range(5)]
    rows += [(10, f"{pad} the wizard came"), *((20 + i, f"the {pad} " * 8) for i in range(40))]
    want = brute_terms(rows)
    assert "wizard" in want and "the" not in want
    for most in (2_000_000, 1):
        monkeypatch.setattr(pii, "MOST_TERMS", most)
        got = {r.doc_id: r.spans for r in personal_data(documents(rows)).collect()}
        for i, t in rows:
            taken = [(s, e) for s, e, _, _ in base_spans(t)]
            places = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in taken)]
            assert sorted(x for x in got[i].split(",") if x.startswith("term")) == sorted(places)
    clean = {r.doc_id: r.text for r in sanitised(documents(rows)).collect()}
    assert "izard" not in "".join(clean.values()) and clean[10].startswith("alphaxa")
    twice = sanitised(documents([rows[0], rows[0], (0, None)])).collect()
    assert len(twice) == 3 and sorted(str(r.text)[:4] for r in twice)[0] == "None"


def test_rows_and_disclosing_terms(documents):
    fillers = [f"{w} {w}er {w}ing" for w in ("alpha", "gamma", "delta", "omega", "sigma", "kappa")]
    rows = [(i, f"the {f} wizard bob@x.org mailed the {f}") for i, f in enumerate(fillers)] + [(20 + i, f"the {f} {20 + i}.1.1.1 the other") for i, f in enumerate(fillers)]
    rows += [(40, None), (41, ""), (42, "a" * 200_000), (0, rows[0][1]), (None, "x@y.zz")]
    got = personal_data(documents(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = plain(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term:")] == base
    words = {text[r.doc_id][int(s) : int(e)] for r in got if r.doc_id is not None for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    assert words == {"wizard", "mailed"}  # they stand beside that address only; "the" and the fillers are anywhere
    counted = {t: n for t, n in brute_terms(rows).items()}
    assert words == set(counted)
    clean = {r.doc_id: r.text for r in sanitised(documents(rows[:3])).collect()}
    assert clean[0].startswith("the alpha") and "[EMAIL]" in clean[0] and "@" not in clean[0]
    assert personal_data(documents([])).collect() == []


def test_copies_do_not_hide_a_disclosing_term(documents):
    """Twenty copies of one text scale what stands with the entity and what does not alike."""
    pad = " ".join(f"{w}{v}" for w in ("alpha", "gamma", "delta", "omega") for v in ("xa", "yb", "zc", "wd", "ve", "uf"))
    rows = [(i, f"{pad} {'uvwxyz'[i]}uno wizard bob@x.org {'uvwxyz'[i]}dos {pad} İstanbul {pad}") for i in range(5)]
    others = [(100 + i, f"{pad} the {pad} İstanbul") for i in range(60)]
    for given_rows in (rows + others, rows + others + [(200 + i, rows[0][1]) for i in range(20)]):
        want = set(brute_terms(given_rows))
        got = {r.doc_id: r.spans for r in personal_data(documents(given_rows)).collect()}
        found = {t[int(s) : int(e)].lower() for i, t in given_rows for k, s, e in (x.split(":") for x in got[i].split(",") if x) if k == "term"}
        assert found == want and "wizard" in want
    same = [(i, rows[0][1]) for i in range(25)] + others  # one neighbourhood is no evidence, however often
    assert not any("term" in r.spans for r in personal_data(documents(same)).collect())
    assert sanitised(documents([])).collect() == []
