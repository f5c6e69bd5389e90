"""Very long texts, nulls in any column and clashing names through the operators that need them, and through the pipeline's stages."""

from collections import Counter

import corpus_pipeline as cp
from causerie.llm import chat, mixing, sharding, simhash
from tests.llm.test_language import corpus

LONG = "long words " * 50_000


def test_long_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG)], "conv_id bigint, turn bigint, role string, text string")
    (r,) = chat.expand_turns(turns).collect()
    assert r.text[r.loss_start : r.loss_end] == LONG + "<|end|>\n" and len(r.text) > 2 * len(LONG)
    docs = spark.createDataFrame([(1, "a"), (2, LONG), (3, "b")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.start_byte, r.shard) for r in sharding.shard(docs, 4).collect()}
    assert got == {1: (1, 0, 0), 2: (len(LONG), 1, 0), 3: (1, len(LONG) + 1, 3)}


def test_the_row_kept_of_repeated_ones_is_defined(spark):
    rows = [(1, "one two three four", "s", i) for i in range(6)] + [(2, "", None, None), (2, "", None, None), (None, None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, f1 string, key_id int")
    kept = [sorted(map(str, simhash.keep_one_each(frame.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 4


def test_mix_with_nulls(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "a", "s"), (1, "a", "s"), (2, "", "s")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, mix_source string")
    assert mixing.keep_mix(frame, 1.0).columns == frame.columns


def test_stages_with_clashing_columns_and_nulls(spark, tmp_path):
    rows = [(i, t, lang, None if i % 4 == 0 else "s", i, "x", 1.0) for i, t, lang in corpus(60, 9)]
    rows += [(500, LONG, "en", "s", 1, None, None), (None, rows[1][1] + " und", None, None, None, None, None), (501, None, None, None, None, None, None), *rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, h int, language string, bin_id double")
    names, docs = docs.columns, docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names and not Counter(map(str, docs.collect())) - Counter(map(str, before.collect()))
    assert docs.count() > 0 and before.where("doc_id = 500").count() <= 1
