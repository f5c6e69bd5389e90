"""Tables, marked texts, audits, the annotator's chain, and small helpers."""

import json

import pytest

from causerie import __main__ as cli
from causerie import language
from causerie.functions import text as tx
from causerie.operators import annotation, spans
from causerie.operators.syntax import TOKENS, Sentences
from causerie.sources import jsonl
from causerie.sources.registry import reader
from tests.test_syntax import TALK, rows, words


def test_merge_nested():
    into = {"a": {"b": 1, "c": {"d": 2}}, "x": 1}
    assert tx.merge_nested(into, {"a": {"c": {"e": 3}}, "x": {"y": 1}, "z": 0}) is into
    assert into == {"a": {"b": 1, "c": {"d": 2, "e": 3}}, "x": {"y": 1}, "z": 0}


def test_table_and_marked_text():
    lines = [{"actor": "Марта", "replica": "Да.", "start": 2, "end": 5}, {"actor": None, "replica": "Нет.", "start": 8, "end": 12}, {"actor": "МАРТА", "replica": "Так.", "start": 15, "end": 19}]
    assert annotation.table(lines, False) == "Марта | Да.\n-     | Нет.\nМАРТА | Так.\n"
    painted = annotation.table(lines).splitlines()
    assert painted[0].startswith("\x1b[31mМарта") and painted[2].startswith("\x1b[31mМАРТА") and painted[1].startswith("-")
    text = "– Да.\n– Нет.\n– Так."
    assert annotation.marked(text, lines) == "– \x1b[31mДа.\x1b[0m\n– \x1b[7mНет.\x1b[0m\n– \x1b[31mТак.\x1b[0m" and annotation.table([]) == ""


def test_source_text():
    assert annotation.source_text(" a \n") == ("a", None)
    assert annotation.source_text(f"t\n{'-' * 20}\nx::y\nz\n{'-' * 20}\nq = r\n") == ("t", [("x", "y")])


def test_colours(spark):
    frame = spark.createDataFrame([("d", 0, None), ("d", 1, "b"), ("d", 2, "a"), ("d", 3, "b"), ("e", 0, "z")], "doc_id string, seq int, actor string")
    assert sorted(((r.doc_id, r.seq, r.colour) for r in annotation.coloured(frame).collect())) == [("d", 0, None), ("d", 1, 0), ("d", 2, 1), ("d", 3, 0), ("e", 0, 0)]


def test_cue_without_bounds_and_count(spark, tmp_path):
    said = {"start": 0, "end": 1, "cue": {}}
    whole = {"start": 0, "end": 1, "cue": {"start": 1, "end": 2}}
    doc = {"doc_id": "d", "lang": "ru", "domain": "prose", "source": "s", "license": "l", "text": "ab", "replicas": [said, whole]}
    (tmp_path / "in.jsonl").write_text(json.dumps(doc) + "\n\n", encoding="utf-8")
    docs = jsonl.read(spark, str(tmp_path / "in.jsonl"))
    assert [r.cue and r.cue.start for r in docs.first().replicas] == [None, 1] and docs.first().characters == []
    assert jsonl.write(docs, str(tmp_path / "out")) == 1


def test_novels_without_tables_warn(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x", encoding="utf-8")
    with pytest.warns(UserWarning, match="quotation_info"):
        assert reader("pdnc")(spark, str(tmp_path)).collect() == []


def test_annotators_chain(spark):
    def annotator(docs):
        return spark.createDataFrame(rows(TALK) + rows("Шепчет/шептать/NOUN он/он/PRON ?/PUNCT –/–/PUNCT Да/да ./PUNCT|", "e"), TOKENS)

    found = language.annotated_tokens(spark.createDataFrame([("d", "x")], "doc_id string, text string"), annotator=annotator)
    got = {(r.doc_id, r.i): r for r in found.collect()}
    assert got["e", 0].pos == "VERB" and [got["e", i].sentence for i in range(6)] == [1, 1, 1, 2, 2, 2]
    lines, number = [], 1
    for w in words(TALK):
        lines.append(number)
        number += w.newline
    assert [got["d", i].line_no for i in range(len(lines))] == lines
    starts = Sentences(words(TALK)).sentences
    assert [got["d", i].sentence for i in range(len(lines))] == [sum(s <= i for s in starts) for i in range(len(lines))]


def test_spans(spark):
    s = spark.createDataFrame([("d", 1, 3), ("d", 4, 9), ("d", 6, 7), ("d", None, 3), ("e", 1, 2)], "doc_id string, start int, end int")
    outer = spark.createDataFrame([("d", 0, 5), ("d", 1, 2), ("d", 5, 7)], "doc_id string, start int, end int")
    assert sorted((str(r.start), r.end, r.inside) for r in spans.inside(s, outer, "doc_id").collect()) == [("1", 2, False), ("1", 3, True), ("4", 9, False), ("6", 7, True), ("None", 3, False)]
    lines = spark.createDataFrame([("d", 1, 0), ("d", 2, 4)], "doc_id string, line_no int, start int")
    assert sorted((r.start, r.start_line, r.end_line) for r in spans.line_span(s.where("start IS NOT NULL AND doc_id = 'd'"), lines, "doc_id").collect()) == [(1, 1, 1), (4, 2, 2), (6, 2, 2)]
    given = spark.createDataFrame([("d", "x", "q")], "doc_id string, replica string, actor string")
    found = spark.createDataFrame([("d", 0, "x", "a"), ("d", 1, "y", None)], "doc_id string, seq int, replica string, actor string")
    assert sorted(r.actor or "" for r in spans.prefilled(found, given).collect()) == ["", "q"]


def test_play_and_payload_of_a_folder(spark, tmp_path, capsys):
    for name, who in (("b", "Яков"), ("a", "Марта")):
        (tmp_path / f"{name}.txt").write_text(f"– Да, – сказал {who}.\n" if who == "Яков" else f"– Да, – сказала {who}.\n", encoding="utf-8")
    assert cli.main(["play", str(tmp_path), "--plain"], spark) == 0 and capsys.readouterr().out == "Марта | Да,\nЯков | Да,\n"
    assert cli.main(["play", str(tmp_path / "a.txt"), "--marked"], spark) == 0 and "\x1b[31mДа,\x1b[0m" in capsys.readouterr().out
    assert cli.main(["payload", str(tmp_path)], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
