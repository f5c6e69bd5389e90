"""Rows repeated more often than the sample has places."""

from pyspark.sql import functions as F

from causerie.llm import language as lid
from tests.llm.test_language import docs


def test_repeated_row_takes_one_place(spark):
    texts = docs(spark, [(i, f"text number {i}", "en") for i in range(40)] + [(50 + i, f"texto {i}", "es") for i in range(5)])
    first = texts.where("lang = 'en'").orderBy(F.xxhash64("doc_id", "text")).limit(1)
    many = texts.unionByName(first.crossJoin(spark.range(300)).drop("id"))
    got = lid.sample(many, rows=20)
    assert len(got["en"]) == len(set(got["en"])) == 20 and len(got["es"]) == 5
    assert got == lid.sample(texts, rows=20)
