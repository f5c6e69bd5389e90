"""Annotations are written by hand: text/lemma/POS/dep/head/features, a | ends a line."""

from causerie.operators import annotated, replicas, speakers
from causerie.operators.syntax import TOKENS, Sentences, Word, agrees, morph_distance


def rows(spec: str, key: str = "d") -> list[tuple]:
    out, at = [], 0
    for i, part in enumerate(spec.split()):
        newline = part.endswith("|")
        text, lemma, pos, dep, head, feats = (part.rstrip("|").split("/") + [""] * 6)[:6]
        morph = dict(f.split("=") for f in feats.split(",") if "=" in f)
        ent = "PER" if pos == "PROPN" else None
        out.append((key, i, at, at + len(text), text, newline, lemma or text.lower(), pos or "X", dep or "dep", int(head) if head else i, morph, ent))
        at += len(text) + 1
    return out


def words(spec):
    return [Word(*r[1:]) for r in rows(spec)]


NOM = "Case=Nom,Number=Sing"
TALK = f"""–/–/PUNCT Пойдём/пойти/VERB/ROOT/1/Person=First ,/,/PUNCT –/–/PUNCT сказала/сказать/VERB/parataxis/1/Gender=Fem,Number=Sing Марта/марта/PROPN/nsubj/4/{NOM},Gender=Fem,Animacy=Anim ./PUNCT –/–/PUNCT Уже/уже/ADV поздно/поздно/ADV/ROOT/9 ./PUNCT|
–/–/PUNCT Нет/нет/PART/ROOT/12 ,/,/PUNCT –/–/PUNCT ответил/ответить/VERB/parataxis/12/Gender=Masc,Number=Sing старый/старый/ADJ/amod/17/{NOM},Gender=Masc Яков/яков/PROPN/nsubj/15/{NOM},Gender=Masc,Animacy=Anim ./PUNCT|
–/–/PUNCT Да/да/PART/ROOT/20 !/PUNCT –/–/PUNCT крикнула/крикнуть/VERB/parataxis/20/Gender=Fem,Number=Sing она/она/PRON/nsubj/23/{NOM},Gender=Fem,Person=Third ./PUNCT|
–/–/PUNCT Ладно/ладно/ADV/ROOT/27 ./PUNCT|"""


def test_lines_by_syntax(spark):
    df = spark.createDataFrame(rows(TALK) + rows(TALK, "e"), TOKENS)
    got = sorted((r.doc_id, r.seq, r.replica, r.actor, r.rule) for r in annotated.lines(df).collect())
    want = [("Пойдём ,", "Марта", "named_inside"), ("Уже поздно .", "Марта", "same_line"), ("Нет ,", "старый Яков", "named_after"), ("Да !", "Марта", "named_after"), ("Ладно .", "старый Яков", "alternation")]
    assert [g[2:] for g in got if g[0] == "d"] == want == [g[2:] for g in got if g[0] == "e"]


def test_no_note_without_a_doer():
    spec = "–/–/PUNCT Дорога/дорога/NOUN/ROOT/1 ,/,/PUNCT –/–/PUNCT думаю/думать/VERB/parataxis/1/Person=First я/я/PRON/nsubj/4/Case=Nom,Person=First ./PUNCT|"
    ws, seen = words(spec), words(spec.replace("думаю/думать", "вижу/видеть"))
    assert annotated.noted(Sentences(ws))(ws, 3, 1) == (7, 0) and Sentences(ws).tells_of_speech((4, 6))
    assert annotated.noted(Sentences(seen))(seen, 3, 1) is None and not Sentences(seen).tells_of_speech((4, 6))
    sound = "–/–/PUNCT Бах/бах/INTJ –/–/PUNCT бах/бах/INTJ !/PUNCT –/–/PUNCT бах/бах/INTJ !/PUNCT|"
    assert Sentences(words(sound)).onomatopoeia(5, 1) and not Sentences(words(sound)).onomatopoeia(5, 3)


def test_chunks():
    spec = f"Старый/старый/ADJ/amod/1/{NOM} мельник/мельник/NOUN/nsubj/4/{NOM},Animacy=Anim с/с/ADP/case/3 ножом/нож/NOUN/nmod/1/Case=Ins,Number=Sing,Animacy=Inan вышел/выйти/VERB/ROOT/4 и/и/CCONJ девочка/девочка/NOUN/conj/4/{NOM},Animacy=Anim|"
    doc = Sentences(words(spec))
    assert doc.chunks == [(0, 4), (6, 7)] and doc.chunk(1) == (0, 4) and doc.chunk(4) == (4, 5)
    assert doc.key((0, 4)) == "старый мельник с ножом" and not doc.inanimate((0, 4)) and doc.root((0, 4)).text == "мельник"
    assert doc.below(4) == {0, 1, 2, 3, 6} and doc.ancestors(0) == [1, 4]
    assert doc.candidates(4, (0, 0)) == [1] and doc.top_verbs((0, 7), (0, 0)) == [4] and doc.best([1, 6]) == 1


def test_best_prefers_people():
    spec = f"Дом/дом/NOUN/nsubj/2/{NOM},Animacy=Inan Ивану/иван/PROPN/obj/2/Case=Dat,Animacy=Anim сказал/сказать/VERB/ROOT/2 он/он/PRON/nsubj/2/{NOM},Person=Third|"
    doc = Sentences(words(spec))
    assert doc.words[doc.best([0, 1, 3])].text in ("Ивану", "он") and doc.best([]) is None
    assert morph_distance(doc.words[0], doc.words[3], "Case", "Number", "Voice") == 0 and agrees(doc.words[0], doc.words[3])
    assert doc.collective((0, 1)) is False and doc.words[2].speech and doc.words[3].reference


def test_tails():
    spec = "–/–/PUNCT Ты/ты/PRON/nsubj/1/Person=Second ,/,/PUNCT –/–/PUNCT правда/правда/NOUN тебе/ты/PRON/obl/4/Person=Second ?/PUNCT –/–/PUNCT он/он/PRON|"
    ws = words(spec)
    out = annotated.with_tails(ws, [annotated.Said(1, 3)])
    assert (out[0].lo, out[0].hi) == (1, 7)


def test_empty(spark):
    assert annotated.lines(spark.createDataFrame([], TOKENS)).collect() == []


def placed(spec):
    """Words with their lines."""
    ws, line = words(spec), 1
    for w in ws:
        w.line = line
        line += w.newline
    return ws


def test_imperatives_in_both_lines():
    ws = placed(f"{TALK}\n–/–/PUNCT Иди/идти/VERB/ROOT/31/Mood=Imp !/PUNCT|\n–/–/PUNCT Стой/стоять/VERB/ROOT/34/Mood=Imp !/PUNCT|")
    doc = Sentences(ws)
    told = speakers.Fold(doc, replicas.extract(ws, annotated.noted(doc)))()
    assert [(doc.shown(a), r) for _, a, r in told][-2:] == [("Марта", "alternation"), ("Марта", "imperatives")]


def test_regions_and_antecedents():
    spec = f"Вошла/войти/VERB/ROOT/0/Gender=Fem,Number=Sing Марта/марта/PROPN/nsubj/0/{NOM},Gender=Fem,Animacy=Anim ./PUNCT Дом/дом/NOUN/ROOT/3/{NOM},Gender=Masc,Animacy=Inan ./PUNCT| –/–/PUNCT Да/да/PART/ROOT/6 ,/,/PUNCT –/–/PUNCT сказала/сказать/VERB/parataxis/6/Gender=Fem,Number=Sing она/она/PRON/nsubj/9/{NOM},Gender=Fem,Person=Third ./PUNCT|"
    ws = placed(spec)
    doc = Sentences(ws)
    said = replicas.extract(ws, annotated.noted(doc))
    assert [(s.lo, s.hi, s.tag) for s in said] == [(6, 8, "before_ending")]
    search = speakers.Search(doc, speakers.Cast(doc))
    assert doc.sentences == [0, 3, 5] and list(search.regions([(6, 8), (9, 11)])) == [(3, 4), (0, 3)]
    assert search.antecedent((0, 5), 10) == (1, 2) and doc.above(6) == (0, 4) and doc.trimmed((5, 12)) == (6, 11)
    assert [(doc.shown(a), r) for _, a, r in speakers.Fold(doc, said)()] == [("Марта", "named_after")]


def test_phrases():
    spec = f"Один/один/NUM/nsubj/7/{NOM} из/из/ADP/case/2 них/они/PRON/nmod/0/Case=Gen,Person=Third молодой/молодой/ADJ/amod/6/{NOM} человек/человек/NOUN/nmod/6/{NOM} –/–/PUNCT паук/паук/NOUN/nsubj/7/{NOM},Animacy=Anim ждал/ждать/VERB/ROOT/7|"
    doc = Sentences(words(spec))
    assert doc.indefinite((0, 3)) and doc.vague((0, 1)) and doc.settled((4, 7)) == (6, 7) and doc.hyphenated((5, 7)) == (3, 7)
    assert doc.key((4, 7)) == "паук" and doc.key((4, 7), False) == "человек – паук" and doc.mentions((0, 8), (6, 7)) == {"subject", "verbal"}
    voices = Sentences(words(f"Женский/женский/ADJ/amod/1/{NOM} голос/голос/NOUN/nsubj/1/{NOM}|"))
    assert voices.refers((0, 2)) and not voices.refers((1, 2)) or voices.chunk(1) == (0, 2)
    circle = words("а/а/X/dep/1 б/б/X/dep/2 в/в/X/dep/0|")
    assert len(Sentences(circle).depth) == 3 and Sentences(circle).root((0, 3)) in circle


def test_all_scenes_with_other_names():
    from causerie import catalogue_annotated as ca
    from causerie.plans import scenes

    for name, (lines, more) in scenes.SCENES.items():
        rows_, first, cycle = ca.EXPECTED[name]
        want = rows_ + first + [r for k in range(4) for r in (cycle[k % len(cycle)] if cycle else [])]
        found = scenes.scene(lines + ([more] * 5 if more else []))
        for a, b in zip(scenes.WOMEN, scenes.MEN):
            swap = {"@A": a, "@B": b, "@a": a.lower(), "@b": b.lower()}
            ws, at, line = [], 0, 1
            for i, w in enumerate(found):
                text, lemma = swap.get(w["text"], w["text"]), swap.get(w["lemma"], w["lemma"])
                ws.append(Word(i, at, at + len(text), text, w["newline"], lemma, w["pos"], w["dep"], w["head"], w["morph"], w["ent"], line))
                at, line = at + len(text) + 1, line + w["newline"]
            doc = Sentences(ws)
            told = speakers.Fold(doc, annotated.with_tails(ws, replicas.extract(ws, annotated.noted(doc))))()
            got = [(doc.shown((s.lo, s.hi)), x and doc.shown(x), r) for s, x, r in told]
            named = lambda v: v and v.replace("@A", a).replace("@B", b)  # noqa: E731, B023
            assert got == [(named(t), named(x), r) for t, x, r in want], name


def test_long_documents_take_time_in_proportion():
    import time

    def seconds(n):
        ws = placed("\n".join([TALK] * n))
        for k, w in enumerate(ws):
            w.i, w.start, w.end = k, w.start + 1000 * k, w.end + 1000 * k
            w.head += 0 if w.head > k else 0
        doc = Sentences(ws)
        began = time.perf_counter()
        speakers.Fold(doc, replicas.extract(ws, annotated.noted(doc)))()
        return time.perf_counter() - began

    seconds(5)
    assert seconds(200) < 8 * seconds(50) + 0.2


def test_language(spark):
    import pytest

    from causerie import language

    assert language.load(" RU ").language == "ru" and language.load("en") is None
    assert language.model_name("md", lambda n: 1) == "ru_core_news_md"
    with pytest.warns(UserWarning):
        assert language.model_name("lg", lambda n: 1 if n.endswith("sm") else None) == "ru_core_news_sm"
    with pytest.raises(ModuleNotFoundError):
        language.model_name("sm", lambda n: None)
    with pytest.raises(ValueError):
        language.model_name("xl")
    df = language.corrected(spark.createDataFrame(rows("Шепчет/шептать/NOUN он/он/PRON"), TOKENS), {"шепчет": "VERB"})
    assert [r.pos for r in df.orderBy("i").collect()] == ["VERB", "PRON"]
    pipeline, docs = language.load("ru"), spark.createDataFrame([("d", "– Да, – сказала Марта.")], "doc_id string, text string")
    assert pipeline.replicas(docs).first().replica == "Да," and pipeline.play(docs).first().actor == "Марта"
    assert pipeline.play(docs, spark.createDataFrame(rows(TALK), TOKENS)).count() == 5
