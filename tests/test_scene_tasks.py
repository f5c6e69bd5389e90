"""Scenes: tokens of a task don't grow with the table, and offsets are those of running sums."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from causerie.operators import annotated
from causerie.plans import scenes


def test_scenes_are_dealt_out_and_not_sorted_twice(spark, monkeypatch):
    monkeypatch.setattr(scenes, "TASK_TOKENS", 100)
    turns = spark.createDataFrame([(c, t, "user", "x") for c in [*range(60), None] for t in range(1 + (c or 0) % 4)] + [(99, 0, "user", " ")], "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    found = scenes.tokens(turns, *scenes.SCENES["pronoun_recent"])
    rows = found.collect()
    want = F.coalesce(F.sum(F.char_length("text") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert found.where("doc_id IS NULL").count() and found.where("doc_id = '99'").isEmpty()
    assert found.withColumn("want", want).where("start <> want OR end <> want + length(text)").isEmpty()
    assert {r.text for r in rows if r.doc_id == "4"} >= {"Анна", "Пётр"} and all(r.text != "@A" for r in rows)
    tasks = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > len(rows) / 100 / 2 and max(r["count"] for r in tasks) < len(rows) / 4
    plan = annotated.lines(found)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
