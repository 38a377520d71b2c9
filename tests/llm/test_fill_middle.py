import hashlib
import random
import re

from enthyme.llm.fill_middle import RATE, digests, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(i, text, rate=RATE):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows(seed):
    rng = random.Random(seed)
    parts = ["word", "é", "日本", "𐐀𐐁", " ", "\n\n", "\t", "\x0b", "\x0c\r", "\xa0", " ", "<", ">", "<P", "S>", "<M>", "<<S", "\x00", "a" * 300]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(400)]
    texts += [None, "", " ", "\n \n", "x", " x", "x ", "<P>", "a<S", "<", ">", "P>", "w " * 100_000, "é" * 50_000]
    return list(enumerate(texts)) + [(3, "again three"), (3, "again three"), (None, "no id at all"), (None, None)]


def key(r):
    return tuple((x is None, x) for x in r)


def test_against_brute_force(documents):
    for rate in (RATE, 100):
        given = rows(rate)
        got = sorted((tuple(r) for r in fill_in_middle(documents(given).repartition(3), rate=rate).collect()), key=key)
        assert got == sorted((expected(i, t, rate) for i, t in given), key=key)
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_text_is_rebuilt(documents):
    given = rows(7)
    made = fill_in_middle(documents(given), rate=100)
    got = made.select("doc_id", restored(made.output, made.form).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in got), key=key) == sorted(((i, t or "") for i, t in given), key=key)


def test_digests_and_empty_table(documents):
    given = rows(8)
    got = sorted((tuple(r) for r in digests(documents(given)).collect()), key=key)
    want = [(*e[:5], hashlib.sha256(e[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), e in ((r, expected(*r)) for r in given)]
    assert got == sorted(want, key=key)
    assert digests(documents([])).collect() == []
