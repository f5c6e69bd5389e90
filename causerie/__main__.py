"""python -m causerie: eval, convert, download, stats, audit, payload and play."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.functions.text import pred_actor_key
from causerie.operators import annotation, attribution, evaluation, quality
from causerie.sources import download, jsonl, native
from causerie.sources.common import whole_files
from causerie.sources.registry import reader

BLIND = 2


def predictions(parsed: DataFrame) -> DataFrame:
    """(path, seq, actor, replica) that the engine finds in the texts of parsed annotated files."""
    found = attribution.lines(parsed.select(F.col("path").alias("doc_id"), "text")).join(parsed.select(F.col("path").alias("doc_id"), "aliases"), "doc_id")
    return found.select(F.col("doc_id").alias("path"), "seq", pred_actor_key(F.col("actor"), F.col("actor"), F.col("aliases")).alias("actor"), "replica")


def evaluate_files(parsed: DataFrame) -> DataFrame:
    return evaluation.align(native.gold(parsed), predictions(parsed), "path")


def evaluate_documents(docs: DataFrame) -> DataFrame:
    """Interchange documents against what the engine finds in their texts."""
    found = attribution.lines(docs.select("doc_id", "text")).join(evaluation.aliases_of(docs), "doc_id")
    pred = found.select("doc_id", "seq", pred_actor_key(F.col("actor"), F.col("actor"), F.col("aliases")).alias("actor"), "replica")
    return evaluation.align(evaluation.gold_of(docs), pred, "doc_id")


def held_out(paths: list[str]) -> bool:
    return any("heldout" in PurePosixPath(p).parts for p in paths)


def audit_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, disagreements, verdict) of annotated files."""
    parsed = native.sections(whole_files(spark, path, "*.txt"))
    docs = native.to_docs(parsed)
    missing = native.unlocatable(parsed, docs).select("doc_id", F.lit("not_found").alias("rule"), F.lit(None).cast("int").alias("at"), F.col("missing").cast("string").alias("detail"))
    issues = quality.validate(docs).unionByName(missing)
    wrong = evaluation.errors(evaluate_files(parsed), "path")
    return issues, wrong, quality.audit(issues, wrong)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causerie")
    commands = parser.add_subparsers(dest="command", required=True)
    e = commands.add_parser("eval")
    e.add_argument("paths", nargs="+")
    e.add_argument("--jsonl", action="store_true")
    e.add_argument("--json", action="store_true")
    e.add_argument("--errors", action="store_true")
    e.add_argument("--unblind", action="store_true")
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("path")
    c.add_argument("--out", required=True)
    c.add_argument("--split", choices=["all", "tune", "heldout"], default="all")
    d = commands.add_parser("download")
    d.add_argument("service", help="address below which corpora/NAME is found")
    d.add_argument("corpus")
    d.add_argument("folder")
    for name in ("stats", "audit", "payload", "play"):
        p = commands.add_parser(name)
        p.add_argument("path")
        if name == "play":
            p.add_argument("--marked", action="store_true", help="print the text with the lines marked, too")
            p.add_argument("--plain", action="store_true", help="no colours")
    a = parser.parse_args(args)
    if a.command == "eval" and a.errors and held_out(a.paths) and not a.unblind:
        print("errors of held-out texts are not shown", file=sys.stderr)
        return BLIND
    if a.command == "download":
        for name in download.download(a.service, a.corpus, a.folder):
            print(name)
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "eval":
        for path in a.paths:
            if a.jsonl:
                pairs, key = evaluate_documents(jsonl.read(spark, path).where("lang = 'ru'")), "doc_id"
            else:
                parsed = native.sections(whole_files(spark, path, "*.txt"))
                pairs, key = evaluate_files(parsed), "path"
            counted = evaluation.counters(pairs, key)
            if counted.isEmpty():
                print(f"no files in {path}", file=sys.stderr)
                return 1
            if a.json:
                whole = evaluation.micro(counted).first().asDict()
                print(json.dumps({"path": path, "files": [r.asDict() for r in counted.collect()], **whole}, ensure_ascii=False))
            else:
                for r in sorted(evaluation.report(counted, key).collect(), key=lambda r: (r[key] is None, r[key] or "")):
                    print(r[key] or "all", r["line"])
                for r in evaluation.by_qtype(pairs).collect():
                    print(r["qtype"], r["n_gold"], r["n_matched"], r["n_correct"])
            if a.errors:
                for r in evaluation.errors(pairs, key).orderBy(key, "seq").collect():
                    print(f"{r[key]}: gold {r['gold']}, predicted {r['pred']}: {r['replica']}")
        return 0
    if a.command == "convert":
        docs = quality.keep_split(reader(a.source)(spark, a.path), a.split)
        for r in quality.validate(docs).collect():
            print(*r, file=sys.stderr)
        print(jsonl.write(docs, a.out), "documents")
        return 0
    if a.command == "stats":
        for r in quality.corpus_stats(jsonl.read(spark, a.path)).collect():
            print(f"{r.source:<16}{r.lang:<4}{r.domain:<8}{r.docs:>8}{r.replicas:>10}{r.characters:>8}")
        return 0
    if a.command == "audit":
        issues, wrong, verdict = audit_files(spark, a.path)
        v = verdict.first()
        print(evaluation.audit_report(v, issues.orderBy("doc_id", "rule", "at").collect(), evaluation.audit_lines(wrong).orderBy("low", "path", "seq").collect()), end="")
        return 0 if v.clean else 1
    for r in whole_files(spark, a.path, "*", False).orderBy("path").toLocalIterator():
        if a.command == "payload":
            text, gold = annotation.source_text(r.content)
            print(json.dumps(annotation.payload(text, gold), ensure_ascii=False))
        else:
            text = r.content.split(annotation.DASHES)[0]
            rows = attribution.rows_of("", text)
            if a.marked:
                print(annotation.marked(text, rows))
            print(annotation.table(rows, not a.plain), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
