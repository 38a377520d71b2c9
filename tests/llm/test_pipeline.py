import random

import corpus_pipeline
from enthyme.llm.language_id import identified
from test_decontaminate import brute as leaks
from test_language_id import rows as languages
from test_ngram_join import brute as components


def test_stages_against_brute_force(documents, spark, tmp_path):
    rng = random.Random(5)
    data = languages(150, 9)
    item = " ".join(f"bench{i}" for i in range(30))
    docs = [(i, t, lang, f"src{i % 3}") for i, t, lang in data]
    docs += [(200 + i, docs[i][1].upper(), docs[i][2], "src0") for i in range(20)]
    docs += [(300 + i, docs[i][1] + " tail", docs[i][2], "src1") for i in range(30)]
    docs += [(400, "ka lo mi " + item + " tu ne", "aa", "src2"), (401, None, "aa", None), (402, "99", "aa", "src0"), (403, "", None, None)]
    rng.shuffle(docs)
    df = documents(docs)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text, now = {d[0]: d[1] for d in docs}, df
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "language_id":
            want = {r.doc_id for r in identified(now).collect() if r.lang_pred != "und"}
        elif name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last[text[i].translate({c: c + 32 for c in range(65, 91)})] = i
            want = set(last.values())
        elif name == "ngram_join":
            want = {i for i, c in components([(i, text[i]) for i in before], 5, 4, 5).items() if i == c}
        elif name == "decontamination":
            want = before - {d for d, _ in leaks([(i, text[i]) for i in before], [(1, item)])}
        else:
            want = before
        now = stage(spark, now, str(tmp_path))
        assert now.columns[: len(df.columns)] == df.columns and (k == 4 or now.columns == df.columns)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in now.collect()} == want, name
        assert k == 4 or want < before, name
    whole = {(r.doc_id, r.mix_slot, r.mix_seat) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(r.doc_id, r.mix_slot, r.mix_seat) for r in now.collect()}
