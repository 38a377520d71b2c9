import random

from enthyme.operators.collate import agreement, aligned, rising, vote


def test_chain_and_alignment():
    assert rising([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    rng = random.Random(2)
    x = [f"w{rng.randrange(60)}" for _ in range(300)]
    y = list(x)
    for at in (20, 90, 91, 200):
        y[at] = "changed"
    del y[150:155]
    y[40:40] = ["new", "words"]
    got = aligned(x, y)
    assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
    assert len(got) >= len(x) - 9 and aligned([], y) == [] and aligned(x, x) == [(i, i) for i in range(len(x))]


def test_long_gaps_and_moved_blocks():
    words = [f"w{i}" for i in range(100)]
    assert len(aligned(words, words[:50] + ["new"] * 900 + words[50:])) == 100
    line = "the same line again and".split() * 120  # no anchor is unique
    assert len(aligned(line, [*line, "end"])) == 600
    assert len(aligned(line[:-1], ["start"] * 500 + line)) == 599
    assert sorted(aligned(words, words[:40] + words[70:] + words[40:70])) == [(i, i if i < 40 else i - 30 if i >= 70 else i + 30) for i in range(100)]


def test_rates_and_votes(spark):
    pairs = spark.createDataFrame([(1, 2, "a b c d e", "a b x d e"), (1, 3, None, "a")], "a long, b long, text_a string, text_b string")
    assert [(r.equal, r.rate) for r in agreement(pairs).orderBy("b").collect()] == [(4, 0.8), (0, 0.0)]
    readings = spark.createDataFrame([(1, "a", "the"), (1, "b", "the"), (1, "c", "tbe"), (2, "a", "word"), (2, "b", "w0rd"), (3, "a", "x"), (3, "b", "y")], "place int, witness string, reading string")
    got = {r.place: (r.reading, r.by) for r in vote(readings, spark.createDataFrame([("word",), ("the",)], "word string")).collect()}
    assert got == {1: ("the", "majority"), 2: ("word", "lexicon"), 3: (None, "dispute")}
