import json

import pytest

from causerie import __main__ as cli
from causerie.operators import annotation, attribution, replicas, tokens

CASES = [
    ("– Ты где?\n– Дома.", ["Ты где?", "Дома."]),
    ("Он молчал.\n– Пойдём, – сказала Марта. – Уже поздно.\nОни ушли.", ["Пойдём,", "Уже поздно."]),
    ("– Пойдём! – крикнул Яков.", ["Пойдём!"]),
    ("– Дорога, дом – вот и всё.", ["Дорога, дом – вот и всё."]),
    ("Марта сказала: «Не спи» и вышла.", ["Не спи"]),
    ("Он читал «Новую газету» весь день.", []),
    ("«Не спи», – сказала Марта.", ["Не спи"]),
    ("«Не спи.»\nМарта ушла.", ["Не спи."]),
    ("Марта вошла и заговорила:\n– Вставай.", ["Вставай."]),
    ("", []),
    ("–", []),
    ("Без речи – одни слова.", []),
    ("– Обрыв", ["Обрыв"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_extraction(text, want):
    assert [r["replica"] for r in replicas.rows_of("d", text)] == want


def test_tags():
    text = "Марта крикнула:\n– Стой!\n– Стою, – ответил Яков. – А что?\nЯков: «Так»."
    assert [r["tag"] for r in replicas.rows_of("d", text)] == ["after_starting", "before_insertion", "alternation", "after_starting"]


def test_attribution_rules():
    text = "– Пойдём, – сказала Марта. – Уже поздно.\n– Нет, – ответил Яков.\n– Почему?\n– Потому.\nЯков вздохнул.\n– Ладно."
    got = [(r["replica"], r["actor"], r["rule"]) for r in attribution.rows_of("d", text)]
    assert got == [("Пойдём,", "Марта", "named_inside"), ("Уже поздно.", "Марта", "same_line"), ("Нет,", "Яков", "named_after"), ("Почему?", "Марта", "alternation"), ("Потому.", "Яков", "alternation"), ("Ладно.", "Яков", "line_above")]
    assert attribution.rows_of("d", "– Кто?") == [{"doc_id": "d", "seq": 0, "start": 2, "end": 6, "replica": "Кто?", "actor": None, "rule": "none"}]


def test_tokens(spark):
    ts = tokens.tokenize("Он ушёл… – Да?!\n– Я-то :) 😀")
    assert [t.text for t in ts][:6] == ["Он", "ушёл", "…", "–", "Да", "?!"] and ts[-1].newline and [t.line for t in ts][-1] == 2
    assert [t.sentence for t in ts][:5] == [1, 1, 1, 2, 2]
    rows = tokens.tokens(spark.createDataFrame([(1, "a b\nc"), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.text, r.line_no, r.newline) for r in rows] == [("1", "a", 1, False), ("1", "b", 1, True), ("1", "c", 2, True)]


def test_spans():
    ts = tokens.tokenize("Да, (он)\nушёл.")
    assert tokens.line_start(ts, 6) == 5 and tokens.line_end(ts, 0) == 4 and tokens.trim(ts, 1, 5) == (3, 4)
    assert tokens.parenthesized(ts, 3, 4) and not tokens.parenthesized(tokens.tokenize("(а) б в г д е"), 6, 7) and tokens.near(ts, 3, 2, "(") and not tokens.near(ts, 3, 1, "Да")
    assert tokens.contiguous(ts, 1, 3) and tokens.line_breaks(ts, (5, 6), (0, 1)) == 1


def test_distributed_is_as_local(spark):
    rows = [(str(i), t) for i, (t, _) in enumerate(CASES)] + [("null", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted((r.doc_id, r.seq, r.replica) for r in replicas.replicas(df).collect())
    assert got == sorted((i, n, x["replica"]) for i, t in rows for n, x in enumerate(replicas.rows_of(i, t or "")))
    assert attribution.lines(df).count() == len(got)


def test_annotation():
    text = "– Пойдём, – сказала Марта.\nВ саду стоял Яков."
    p = annotation.payload(text, [("яша", "Пойдём,")])
    assert p["replicas"] == [{"start": 2, "end": 9, "text": "Пойдём,", "actor": "яша"}] and p["palette"] == ["марта", "яков"]
    assert annotation.parse_aliases("# x\nA = b | c |\n\n") == {"A": ["b", "c"]}
    with pytest.raises(ValueError):
        annotation.parse_aliases("no sign")
    assert annotation.saved(" t ", [{"actor": "a", "text": "x"}, {"actor": "b", "text": "y", "bogus": True}], {"a": ["b"]}) == f"t\n{'-' * 20}\na::x\n{'-' * 20}\na = b\n"


def test_command_line(spark, tmp_path, capsys):
    good = "– Пойдём, – сказала Марта.\n– Нет, – ответил Яков.\n" + "-" * 20 + "\nМарта::Пойдём,\nЯков::Нет,\n"
    (tmp_path / "a.txt").write_text(good, encoding="utf-8")
    assert cli.main(["eval", str(tmp_path), "--json", "--errors"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["n_gold"] == out["n_correct"] == 2 and out["end_to_end"] == 1.0
    assert cli.main(["eval", "x/heldout/y", "--errors"], spark) == 2
    assert cli.main(["audit", str(tmp_path)], spark) == 0 and "CLEAN" in capsys.readouterr().out
    assert cli.main(["convert", "native", str(tmp_path), "--out", str(tmp_path / "out")], spark) == 0
    assert cli.main(["stats", str(tmp_path / "out")], spark) == 0 and "native" in capsys.readouterr().out
    assert cli.main(["play", str(tmp_path / "a.txt")], spark) == 0 and "Марта" in capsys.readouterr().out
    assert cli.main(["payload", str(tmp_path / "a.txt")], spark) == 0 and json.loads(capsys.readouterr().out)["palette"] == ["марта", "яков"]
    (tmp_path / "b.txt").write_text(good.replace("Яков::", "Пётр::") + "Кто::Нет такого\n", encoding="utf-8")
    assert cli.main(["audit", str(tmp_path)], spark) == 1 and "HIGH" in capsys.readouterr().out
    assert cli.main(["eval", str(tmp_path / "out"), "--jsonl"], spark) == 0
