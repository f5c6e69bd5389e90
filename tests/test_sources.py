"""Each reader over a small file written here; slices of the text give the words meant, and nothing is wrong with the documents."""

import json

import pytest

from causerie.operators import quality
from causerie.sources import jsonl, markup, native, registry, standoff
from causerie.sources.common import character


def cut(doc, spans="replicas"):
    return [doc["text"][s["start"] : s["end"]] for s in doc[spans]]


def clean(spark, rows, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    assert quality.validate(jsonl.read(spark, str(tmp_path / "d.jsonl"))).collect() == []


TEI = """<TEI xmlns="urn:tei"><particDesc><person xml:id="lida" sex="FEMALE"><persName>Лида  Ветрова</persName></person><person xml:id="x"/></particDesc>
<body><sp who="#lida"><speaker>Лида.</speaker><p>Где 😀
 свет?</p><stage>тихо</stage></sp><sp who="#lida #oleg"><speaker>Оба.</speaker><p>Да!</p></sp><sp><p> </p></sp></body></TEI>"""


def test_tei(spark, tmp_path):
    doc = markup.parse_tei("p", TEI)
    assert cut(doc) == ["Где 😀 свет? тихо", "Да!"] and [r["speaker"] for r in doc["replicas"]] == ["lida", None]
    assert cut(doc, "mentions") == ["Лида."] and doc["characters"] == [character("lida", "Лида Ветрова", gender="f")]
    clean(spark, [doc], tmp_path)


def test_quotes_xml():
    doc = markup.parse_quotes("q", '<doc><characters><character name="Nan" aliases="Nan;Nana;" gender="female"/><character name="Nana"/></characters><text>\n<quote speaker="Nana">“Up <mention speaker="Nan">Nan</mention>!”</quote> he <quote speaker="?">no</quote></text></doc>')
    assert cut(doc) == ["“Up ", "no"] and [r["speaker"] for r in doc["replicas"]] == ["char_0", None]
    assert cut(doc, "mentions") == ["Nan"] and doc["characters"][0] == character("char_0", "Nan", ["Nana"], "f")


def test_xmi():
    head = '<xmi:XMI xmlns:t="urn:t" xmlns:cas="urn:c" xmlns:xmi="urn:x"><cas:Sofa sofaString="Er rief Karl: »Komm!«"/>'
    ents = '<t:NamedEntity xmi:id="1" begin="0" end="2" Name="Er" ID="7"/><t:NamedEntity xmi:id="2" begin="8" end="12" Name="Karl" ID="7"/><t:NamedEntity begin="1" end="2"/>'
    said = '<t:DirectSpeech begin="14" end="21" Speaker="1" SpokenTo="99"/><t:DirectSpeech begin="3" end="7" Category="Thought" Speaker="2"/><t:DirectSpeech begin="0" end="1" Category="name"/>'
    doc = markup.parse_xmi("x", head + ents + said + "</xmi:XMI>")
    assert cut(doc) == ["rief", "»Komm!«"] and [(r["speaker"], r["addressee"], r["mode"]) for r in doc["replicas"]] == [("char_7", None, "thought"), ("char_7", None, "speech")]
    assert doc["characters"][0]["name"] == "Karl" and cut(doc, "mentions") == ["Er", "Karl"]


PEOPLE = "Character ID,Main Name,Aliases,Gender,Category\n0,Ann,\"{'Miss A', 'Ann', 'Annie'}\",f,major\n1,,\"['Annie', \"\"O'Hara\"\"]\",M,minor\n"
QUOTES = """quoteID,speaker,quoteType,addressees,quoteByteSpans,referringExpression,mentionSpansList,mentionEntitiesList
1,Annie,Explicit,"[""O'Hara"", 'Ann']","[[13, 20], [29, 34]]",said Ann,"[[[0, 3]], []]","[[['Nobody', 'Ann']]]"
2,Ann,Explicit,[],[],nan,[],[]
3,Zed,Other,nan,"[[0, 3]]",nan,[],[]
"""


def test_novel():
    doc = standoff.parse_novel("n", "Ann spoke.   “Stay!” said Ann. “Here.”", PEOPLE, QUOTES)
    assert [c["aliases"] for c in doc["characters"]] == [["Annie", "Miss A"], ["Annie", "O'Hara"]] and doc["characters"][1]["name"] == "char_1"
    assert [(r["start"], r["speaker"], r["addressee"], r["qtype"]) for r in doc["replicas"]] == [(0, None, None, None), (13, "char_0", "char_1", "explicit"), (29, "char_0", "char_1", "explicit")]
    assert doc["text"][doc["replicas"][1]["cue"]["start"] :].startswith("said Ann") and doc["replicas"][2]["cue"] is None
    assert doc["mentions"] == [{"start": 0, "end": 3, "char": "char_0"}]
    assert standoff.literal("{'b', 'a'}", []) == {"a", "b"} and standoff.literal("oops(", []) == [] and standoff.literal(None, 3) == 3


def test_brat():
    text = "“Go,” cried Tom. “Why?” she asked Tom."
    notes = "T1\tQuote 0 5\tx\nT2\tCue 6 11\tx\nT3\tEntity 12 15\tTom\nT4\tQuote 17 23\tx\nT5\tEntity 24 27\tshe\n\nR1\tSpeaker Arg1:T1 Arg2:T5\nR2\tSpeakerOf Arg1:T1 Arg2:T3\nR3\tCueOf Arg1:T1 Arg2:T2\nR4\tspeaker Arg1:T4 Arg2:T5\nR5\tAddressee Arg1:T4 Arg2:T3\n#1\tnote\n"
    doc = standoff.parse_brat("b", text, notes)
    assert [c["name"] for c in doc["characters"]] == ["she", "Tom"] and len(doc["mentions"]) == 4
    assert [(r["speaker"], r["addressee"], r["cue"]) for r in doc["replicas"]] == [("char_1", None, {"start": 6, "end": 11}), ("char_0", "char_1", None)]


def test_quote_arrays(spark, tmp_path):
    items = [
        {"quote": "“走吧。”", "context": "王五笑道：“走吧。”李四没说话。", "labels": {"说话人-mention": "王五", "说话人-entity": "王五", "听者-entity": ["李四"], "线索": "笑道"}},
        {"quote": "不在", "context": "这里没有", "labels": {}},
        {"quote": "好", "context": "好，张三想", "labels": {"说话人-mention": "张三", "说话人-entity": "张三", "线索": "想"}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    rows = {r.doc_id: r.asDict(True) for r in registry.reader("jy_quoteplus")(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["jy_quoteplus/a/00000", "jy_quoteplus/a/00002"]
    one, two = rows["jy_quoteplus/a/00000"], rows["jy_quoteplus/a/00002"]
    assert cut(one) == ["“走吧。”"] and one["replicas"][0]["addressee"] == "char_1" and one["text"][one["replicas"][0]["cue"]["start"] :].startswith("笑道")
    assert cut(two, "mentions") == ["张三"] and two["text"][two["replicas"][0]["cue"]["start"]] == "想"


NATIVE = "Шёл дождь.\r\n– Кто там? – спросил Олег.\r\n– Я :: тут, я!\n– Кто   там?\n"


def test_native(spark, tmp_path):
    pair_lines = "Олег::Кто там?\nЛиза :: Я :: тут, я!\nNone::Кто там?\nОлег::Чего нет"
    for name, body in (("a/one", NATIVE + "-" * 20 + "\n" + pair_lines + "\n" + "-" * 20 + "\n# имена\nЁжик = Олег | Олежка |\nДругой = олежка\nnone = никто\n"), ("raw/two", "x"), ("three", "текст\n" + "-" * 20 + "\n")):
        path = tmp_path / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body.encode())
    parsed = native.sections(native.whole_files(spark, str(tmp_path), "*.txt"))
    rows = {r.stem: r for r in parsed.collect()}
    assert sorted(rows) == ["one", "three"] and rows["one"].error is None and rows["three"].pairs == []
    one = rows["one"]
    assert one.aliases == {"олег": "ежик", "олежка": "другой", "никто": "none"} and one.pairs[1].asDict() == {"actor": "Лиза", "replica": "Я :: тут, я!"}
    docs = {r.doc_id: r.asDict(True) for r in native.to_docs(parsed).collect()}
    doc = docs["native/one"]
    assert cut(doc) == ["Кто там?", "Я :: тут, я!", "Кто   там?"] and [r["speaker"] for r in doc["replicas"]] == ["char_0", "char_2", None]
    assert [(c["id"], c["name"], c["aliases"]) for c in doc["characters"]] == [("char_0", "ежик", ["олег"]), ("char_1", "другой", ["олежка"]), ("char_2", "лиза", [])]
    assert native.unlocatable(parsed, native.to_docs(parsed)).collect()[0].missing == 1
    bad = spark.createDataFrame([("p", "b", c) for c in ("no sections", "a\n" + "-" * 20 + "\nno colons", "-".join(["-" * 20 + "\n"] * 4), "t\n" + "-" * 20 + "\na::b\n" + "-" * 20 + "\nno sign")], "path string, stem string, content string")
    assert all(r.error for r in native.sections(bad).collect())


def test_native_round_trip(spark):
    rows = spark.createDataFrame([("t", "Line one\nLine two", [("A", "x :: y"), ("B", "z")], {"a": ["b", "c"]})], "stem string, text string, pairs array<struct<actor:string,replica:string>>, names map<string,array<string>>")
    whole = rows.select("stem", native.serialize(rows.text, rows.pairs, rows.names).alias("content"))
    got = native.sections(whole).first()
    assert (got.text, [tuple(p) for p in got.pairs], got.aliases) == ("Line one\nLine two", [("A", "x :: y"), ("B", "z")], {"b": "a", "c": "a"})


def test_registry():
    with pytest.raises(KeyError, match="native"):
        registry.reader("nothing")
    assert len(registry.READERS) == 7


def test_jsonl_keeps_nulls(spark, tmp_path):
    row = {"text": "😀 «Ё»", "doc_id": "d", "license": "l", "replicas": [{"speaker": None, "end": 5, "start": 2}]}
    (tmp_path / "in.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n\n", encoding="utf-8")
    docs = jsonl.read(spark, str(tmp_path / "in.jsonl"))
    assert docs.first().characters == []
    jsonl.write(docs, str(tmp_path / "out"))
    line = next(p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size).read_text(encoding="utf-8")
    assert '"speaker":null' in line and "😀 «Ё»" in line and json.loads(line)["mentions"] == []
