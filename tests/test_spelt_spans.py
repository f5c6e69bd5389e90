"""Sentences and neighbourhoods derived with the tokens of a document, against the operators on tables of tokens."""

import random

from pyspark.sql import functions as F

from causerie import catalogue_files
from causerie.operators import spans, tokens


def test_as_the_window_functions(spark, tmp_path):
    rng = random.Random(5)
    parts = ["Да", "нет", "x1", "_", "½", "-", "–", ",", ".", "...", "?!", "?", "…", "«", "»", "\n", "\n\n", "？", "!…"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " \n", "–", ",", "\n-\n", "a, b c d e f g , h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marked = tokens.tokens(docs, "i", "text", "newline").withColumn("pos", F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), "X").otherwise("PUNCT"))
    want = spans.near(spans.sentences(marked), F.col("text") == ",", 3).select("doc_id", "i", "sentence", "near")
    got = tokens.tokens(docs, "i", sentence=spans.SpeltSentences(), near=spans.SpeltNear(",", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("near").count() > 100
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("annotated_sentences", "tokens_near"):
        plan = catalogue_files.c.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan and plan.count("Exchange") == 1, name
