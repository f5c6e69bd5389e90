from collections import Counter

import corpus_pipeline as cp
from causerie.llm import simhash as sh
from tests.llm.test_language import corpus
from tests.llm.test_mixing import brute as mix_brute


def test_stages_over_a_small_folder(spark, tmp_path):
    rows = corpus(150, 4)
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(400, "", "en"), (401, None, None), (402, "&&& 123", "de"), (None, rows[3][1], "en")]
    full = [(i, t, lang, f"s{(i or 0) % 3}", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept = []
    for k, (name, f) in enumerate(cp.STAGES):
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names
    known, unique, mixed, bins = kept
    assert Counter(r.doc_id for r in known.collect()) == Counter(i for i, t, *_ in full if i not in (400, 401, 402))
    groups = sh.near_duplicates(known).where("kept").collect()
    assert Counter(r.doc_id for r in unique.collect()) == Counter(r.doc_id for r in groups)
    want = mix_brute([(r.doc_id, r.text, r.source) for r in unique.collect()], (1.0,))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(k[0] for k in want.elements())
    assert sum(r.n_tokens for r in bins.collect()) == sum(len(r.text.split()) for r in mixed.collect())
    again = cp.run(spark, str(tmp_path))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, bins.collect()))


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
