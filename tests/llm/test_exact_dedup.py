import hashlib

from enthyme.llm.exact_dedup import deduplicated, duplicate_groups, misra_gries


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


ROWS = [(1, "Same text"), (2, "same TEXT"), (5, "SAME text"), (3, "other"), (4, None), (6, ""), (7, "É"), (8, "é"), (9, "x " * 50_000)]


def test_groups_against_brute_force(documents):
    rows = ROWS + [(100 + i, f"copy {i % 7}") for i in range(60)]
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for share in (0.001, 0.05, 0.9):
        got = {r.doc_id: r for r in duplicate_groups(documents(rows), share=share).collect()}
        assert len(got) == len(rows)
        for t, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
                assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_survivors_keep_their_columns(documents):
    df = documents(ROWS + [(5, "SAME text")])
    got = deduplicated(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 5, 6, 7, 8, 9]


def test_null_ids_and_empty_table(documents):
    rows = [(None, "a"), (None, "a"), (None, "b"), (2, "b")]
    got = sorted((r.text_sha256, r.keep_id, r.kept) for r in duplicate_groups(documents(rows)).collect())
    assert [x[1] for x in got if x[1] is None] == [None, None]
    assert sum(k for _, _, k in got) == 3  # both rows of "a" are the document that stays, and row 2
    assert len(deduplicated(documents(rows)).collect()) == 2
    assert duplicate_groups(documents([])).collect() == []
    assert deduplicated(documents([])).collect() == []


def test_sketch_keeps_what_is_frequent(spark):
    df = spark.createDataFrame([(b"hot",)] * 300 + [(f"{i}".encode(),) for i in range(700)], "v binary").repartition(5)
    found = {bytes(r.value): r.n for r in misra_gries(df, "v", 20).groupBy("value").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert 300 - 1000 / 21 <= found[b"hot"] <= 300
