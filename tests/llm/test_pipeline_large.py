from collections import Counter

import corpus_pipeline
from causerie.llm import simhash as sh
from tests.llm.test_simhash import brute, docs, texts


def test_near_duplicate_stage_laid_out_as_for_6_gb(spark, monkeypatch):
    layout = sh.layout
    monkeypatch.setattr(sh, "layout", lambda n, distance, verified: layout(2_800_000, distance, verified))
    assert sh.layout(0, sh.DISTANCE, sh.VERIFIED)[0] == 2 * sh.BITS
    rows = texts()
    want = Counter()
    for (i, _, keep), n in brute(rows, sh.DISTANCE).items():
        want[i] += n * keep
    assert Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()) == +want
