"""Checks of interchange documents, statistics and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causerie.functions.text import span_ok, split_of
from causerie.schema import DOMAINS, QTYPES

ISSUES = ("doc_id", "rule", "at", "detail")


def validate(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, at, detail): what is wrong with each document. at: number of the replica (by start) or of the mention.

    duplicate_character, domain, replica_bounds, overlap, unknown_speaker, unknown_addressee, qtype, cue_bounds, mention_bounds, unknown_mention.
    Characters are looked up in the document's own array, so nothing is joined. Three passes: one over documents, one over replicas with the only shuffle, which
    numbers them by start, and one over mentions; each row gives all of its issues at once.
    """
    ids = F.coalesce(F.transform("characters", lambda c: c["id"]), F.array().cast("array<string>"))
    base = docs.select("doc_id", "domain", "replicas", "mentions", F.char_length("text").alias("size"), ids.alias("ids"))
    none = F.lit(None)

    def issue(wrong: Column, rule: str, at: Column, detail: Column) -> Column:
        return F.when(wrong, F.struct(F.lit(rule).alias("rule"), at.cast("int").alias("at"), detail.cast("string").alias("detail")))

    def found(df: DataFrame, *issues: Column) -> DataFrame:
        return df.select("doc_id", F.explode(F.array_compact(F.array(*issues))).alias("x")).select("doc_id", "x.*")

    twice = F.filter(F.array_distinct("ids"), lambda i: F.size(F.filter("ids", lambda j: i == j)) > 1)
    about = base.select("doc_id", F.explode(F.concat(F.transform(twice, lambda i: issue(F.lit(True), "duplicate_character", none, i)), F.array_compact(F.array(issue(~F.col("domain").isin(*DOMAINS), "domain", none, F.col("domain")))))).alias("x")).select("doc_id", "x.*")

    reps = base.select("doc_id", "size", "ids", F.posexplode("replicas").alias("n", "r")).select("doc_id", "size", "ids", "n", "r.*")
    w = Window.partitionBy("doc_id").orderBy("start", "n")
    reps = reps.withColumn("at", F.row_number().over(w) - 1).withColumn("reached", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    span = F.format_string("[%d, %d)", "start", "end")
    unknown = lambda c: F.col(c).isNotNull() & ~F.array_contains("ids", F.col(c))
    at, cue = F.col("at"), F.col("cue")
    of_replicas = found(
        reps,
        issue(~span_ok(F.col("start"), F.col("end"), F.col("size")), "replica_bounds", at, span),
        issue(F.col("start") < F.col("reached"), "overlap", at, span),
        issue(unknown("speaker"), "unknown_speaker", at, F.col("speaker")),
        issue(unknown("addressee"), "unknown_addressee", at, F.col("addressee")),
        issue(~F.col("qtype").isin(*QTYPES), "qtype", at, F.col("qtype")),
        issue(cue.isNotNull() & ~span_ok(cue["start"], cue["end"], F.col("size")), "cue_bounds", at, F.format_string("[%d, %d)", "cue.start", "cue.end")),
    )
    ments = base.select("doc_id", "size", "ids", F.posexplode("mentions").alias("at", "m")).select("doc_id", "size", "ids", "at", "m.*")
    of_mentions = found(ments, issue(~span_ok(F.col("start"), F.col("end"), F.col("size")), "mention_bounds", at, span), issue(~F.array_contains("ids", F.col("char")), "unknown_mention", at, F.col("char")))
    return reduce(DataFrame.unionByName, [about, of_replicas, of_mentions])


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that more than one row has, in their order."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key)


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "lang", "domain").agg(F.count("*").alias("docs"), F.sum(F.coalesce(F.array_size("replicas"), F.lit(0))).alias("replicas"), F.sum(F.coalesce(F.array_size("characters"), F.lit(0))).alias("characters")).orderBy("source", "lang", "domain")


def keep_split(docs: DataFrame, split: str = "all", heldout: float = 0.2) -> DataFrame:
    """Documents of a split; documents of the native format are never left out."""
    if split == "all":
        return docs
    return docs.where((F.col("source") == "native") | (split_of(F.col("doc_id"), heldout) == split))


def audit(issues: DataFrame, disagreements: DataFrame) -> DataFrame:
    """(n_issues, n_high, n_low, clean). disagreements: (path, seq, replica, gold, pred); one is high if pred is somebody."""
    a = issues.agg(F.count("*").alias("n_issues"))
    high = F.col("pred") != "none"
    b = disagreements.agg(F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"))
    return a.crossJoin(b).select("*", ((F.col("n_issues") == 0) & (F.col("n_high") == 0)).alias("clean"))
