import random
import zlib

from enthyme.llm.language_id import identified, in_some_language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "er", "ung", "keit", "ver"], "cc": ["eau", "oi", "ment", "que", "é"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))), lang))
    return out


def test_held_out_accuracy_and_folds(documents):
    data = rows(400)
    got = {r.doc_id: r for r in identified(documents(data)).collect()}
    for i, _, _ in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang in data if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.97


def test_labels_of_the_held_out_fold_change_nothing(documents):
    data = rows(200)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in data]
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identified(documents(x)).collect()} for x in (data, other))
    assert a == b


def test_odd_texts(documents):
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "eau " * 40_000, None), (None, "keit ung", "bb"), (1004, "𐐀𐐁", None), (1003, "eau", "cc")]
    df = documents(rows(120) + extra)
    got = identified(df).collect()
    assert len(got) == 127
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert next(r.lang_pred for r in got if r.doc_id is None) == "bb"
    kept = in_some_language(df)
    assert kept.columns == df.columns and kept.count() == 124
    assert identified(documents([])).collect() == []
    assert {r.lang_pred for r in identified(documents([(1, "words", None)])).collect()} == {"und"}
