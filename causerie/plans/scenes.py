"""Annotated scenes for the checks of extraction and attribution: a scene a conversation, with names by its number and lines by its turns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causerie.functions.text import collapse
from causerie.shipping import written

#: Names of a woman and a man, by the number of the conversation; their lemmas are the same in small letters.
WOMEN, MEN = ("Марта", "Анна", "Ольга"), ("Яков", "Пётр", "Иван")
FEATURES = {
    **dict(zip("ngdai", (("Case", c) for c in ("Nom", "Gen", "Dat", "Acc", "Ins")))),
    **dict(zip("mfx", (("Gender", c) for c in ("Masc", "Fem", "Neut")))),
    **dict(zip("123", (("Person", c) for c in ("First", "Second", "Third")))),
    "s": ("Number", "Sing"),
    "p": ("Number", "Plur"),
    "A": ("Animacy", "Anim"),
    "I": ("Animacy", "Inan"),
    "!": ("Mood", "Imp"),
}
#: Words that scenes have often.
SHORT = {
    "@A": "@A:@a:PROPN:nsubj:{v}:nsfA",
    "@B": "@B:@b:PROPN:nsubj:{v}:nsmA",
    "да": "Да:да:PART:ROOT:.",
    "сказала": "сказала:сказать:VERB:parataxis:1:fs",
    "ответил": "ответил:ответить:VERB:parataxis:1:ms",
}
ASK_A = "– да , – сказала @A/4 ."
ASK_B = "– да , – ответил @B/4 ."


def words(line: str) -> list[tuple]:
    """(text, lemma, pos, dep, head in the line, features, entity) of text:lemma:pos:dep:head:features; marks stand alone, WORD/HEAD is one of SHORT."""
    out = []
    for i, item in enumerate(line.split()):
        name, _, head = item.partition("/")
        item = SHORT.get(name, item).replace("{v}", head)
        text, lemma, pos, dep, at, feats = (item.split(":") + [""] * 6)[:6] if item != ":" else (":", "", "", "", "", "")
        if not any(c.isalpha() for c in text):
            out.append((text, text, "PUNCT", "punct", i - 1 if i else 1, [], None))
        else:
            out.append((text, lemma or text.lower(), pos or "ADV", dep or "advmod", i if at in ("", ".") else int(at), [FEATURES[c] for c in feats], "PER" if pos == "PROPN" else None))
    return out


def scene(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    for line in lines:
        base, found = len(out), words(line)
        for k, (text, lemma, pos, dep, head, feats, ent) in enumerate(found):
            out.append({"text": text, "lemma": lemma, "pos": pos, "dep": dep, "head": base + head, "morph": dict(feats), "ent": ent, "newline": k == len(found) - 1})
    return out


#: Tokens of a task; a task sorts those of its documents.
TASK_TOKENS = 200_000


def _named(rows: list[dict], at: int) -> tuple[list[dict], int]:
    """rows with the names of a number and where each begins if all are followed by one character, and the length of all; a conversation without a number has no names."""
    woman, man = ((*WOMEN, None)[at], (*MEN, None)[at])
    texts, lemmas = {"@A": woman, "@B": man}, {"@a": woman and woman.lower(), "@b": man and man.lower()}
    out, start = [], 0
    for r in rows:
        text = texts.get(r["text"], r["text"])
        out.append({**r, "text": text, "lemma": lemmas.get(r["lemma"], r["lemma"]), "start": start})
        start += len(text) + 1 if text is not None else 0
    return out, start


def tokens(turns: DataFrame, lines: list[str], more: str | None = None) -> DataFrame:
    """The table of tokens (syntax.TOKENS) of a scene for each conversation; more: a line that follows once for each turn.

    Conversations are dealt out by doc_id before they are rendered, in as many parts as there are TASK_TOKENS, so what a task holds doesn't grow with the table. Offsets come from those within a line, so nothing is sorted.
    """
    kind = "array<struct<text:string,lemma:string,pos:string,dep:string,head:int,morph:map<string,string>,ent:string,newline:boolean,start:int>>"
    first, again = scene(lines), scene([more] if more else [])
    convs = written(turns.where(collapse(F.col("text")) != "").groupBy("conv_id").agg(F.count("*").cast("int").alias("n")), "scenes")
    total = convs.agg(F.coalesce(F.sum(F.lit(len(first)) + F.col("n") * len(again)), F.lit(0))).first()[0]
    dealt = convs.select("conv_id", F.col("conv_id").cast("string").alias("doc_id"), "n").repartition(max(1, -(-total // TASK_TOKENS), turns.sparkSession.sparkContext.defaultParallelism), "doc_id")
    at = F.coalesce(F.pmod("conv_id", F.lit(len(WOMEN))).cast("int"), F.lit(len(WOMEN)))

    def template(rows: list[dict]):
        kinds = [_named(rows, k) for k in range(len(WOMEN) + 1)]
        return F.get(F.from_json(F.lit(json.dumps([r for r, _ in kinds], ensure_ascii=False)), f"array<{kind}>"), at), F.get(F.array(*(F.lit(n) for _, n in kinds)), at)

    (head, head_size), (line, line_size) = template(first), template(again)
    both = dealt.withColumns({"first": head, "more": line, "at_more": head_size, "size": line_size})
    shifted = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.transform("more", lambda w: w.withField("head", w["head"] + F.size("first") + k * F.size("more")).withField("start", w["start"] + F.col("at_more") + k * F.col("size")))))
    each = both.select("doc_id", F.posexplode(F.concat("first", shifted)).alias("i", "w")).select("doc_id", "i", "w.*")
    stop = F.col("start") + F.char_length("text")
    return each.select("doc_id", "i", "start", stop.cast("int").alias("end"), "text", "newline", "lemma", "pos", "dep", "head", "morph", "ent")


DA = "– Да:да:PART:ROOT:. ."
#: name: (lines, the line that follows once for each turn or None)
SCENES: dict[str, tuple[list[str], str | None]] = {
    "same_line": (["– Пойдём:пойти:VERB:ROOT:.:1p , – сказала @A/4 . – Уже поздно:поздно:ADV:ROOT:. ."], "– да , – ответил @B/4 . – Нет:нет:PART:ROOT:. ."),
    "named_after": ([], ASK_B),
    "named_before": (["@A/1 сказала:сказать:VERB:ROOT:.:fs :", "– Стой:стоять:VERB:ROOT:.:!s !"], None),
    "alternation": ([ASK_A, ASK_B], DA),
    "imperatives": ([ASK_A, ASK_B], "– Иди:идти:VERB:ROOT:.:!s !"),
    "goes_on": ([ASK_A, "« Нет:нет:PART:ROOT:. . »"], None),
    "voice_intro": (["@A/1 сказала:сказать:VERB:ROOT:.:fs в:в:ADP:case:3 голос:голос:NOUN:obl:1:asmI :", "– Стой:стоять:VERB:ROOT:.:!s !", "– Иду:идти:VERB:ROOT:.:1s ."], None),
    "long_intro": ([ASK_B, "– да , – сказала @A/4 " + "и:и:CCONJ:cc:4 " * 55 + ".", "– Завтра пойдём:пойти:VERB:ROOT:.:1p туда мы:мы:PRON:nsubj:2:1pn ."], None),
    "named_above": ([ASK_A, "– да , – вошёл:войти:VERB:parataxis:1:ms @B/4 . Старая:старый:ADJ:amod:8:nsf @A/9 ждала:ждать:VERB:ROOT:.:fs .", DA], None),
    "named_before_vague": ([ASK_A, "– да , – крикнул:крикнуть:VERB:parataxis:1:ms один:один:NUM:nsubj:4:nsm .", "– Ты:ты:PRON:nsubj:2:2ns кто:кто:PRON:ROOT:.:n ? – спросил:спросить:VERB:parataxis:2:ms старик:старик:NOUN:nsubj:5:nsmA .", "– Я:я:PRON:ROOT:.:1ns ."], None),
    "reflexive": (["@B/1 вошёл:войти:VERB:ROOT:.:ms .", ASK_A, "– Видит:видеть:VERB:ROOT:. себя:себя:PRON:obj:1:a ."], None),
    "no_subject": (["@B/1 вошёл:войти:VERB:ROOT:.:ms .", ASK_A, "– Видишь:видеть:VERB:ROOT:.:2s ."], None),
    "above_previous": (["@B/1 вошёл:войти:VERB:ROOT:.:ms .", ASK_A, DA], None),
    "before_previous": (["@B/1 крикнул:крикнуть:VERB:ROOT:.:ms : « Стой:стоять:VERB:ROOT:.:!s . »", DA], None),
    "penult": ([ASK_A, ASK_B, "– да , – стемнело:стемнеть:VERB:ROOT:.:xs небо:небо:NOUN:nsubj:4:nsxI ."], None),
    "answer": ([ASK_A, "– Ты:ты:PRON:nsubj:2:2ns где:где:ADV:ROOT:. , – спросил:спросить:VERB:parataxis:2:ms @B/5 .", "– Я:я:PRON:nsubj:2:1ns тут:тут:ADV:ROOT:. , – ответила:ответить:VERB:parataxis:2:fs старушка:старушка:NOUN:nsubj:5:nsfA ."], None),
    "line_above": ([ASK_B, "@A/1 обернулась:обернуться:VERB:ROOT:.:fs .", "– да , – стемнело:стемнеть:VERB:ROOT:.:xs небо:небо:NOUN:nsubj:4:nsxI ."], None),
    "bracketed": ([ASK_A, ASK_B, "– да , – ( сказал:сказать:VERB:parataxis:1:ms @B/5 ) : – Нет:нет:PART:ROOT:. ."], None),
    "between": ([ASK_A, ASK_B, "@A/2 долго смотрела:смотреть:VERB:ROOT:.:fs в:в:ADP:case:4 окно:окно:NOUN:obl:2:asxI .", DA], None),
    "spoke_before": ([ASK_A, ASK_B, "@A/1 сказала:сказать:VERB:ROOT:.:fs это:это:PRON:obj:1:as тихо .", DA], None),
    "between_reflexive": ([ASK_A, ASK_B, "@A/1 слушала:слушать:VERB:ROOT:.:fs , говорили:говорить:VERB:parataxis:1:p громко .", "– Жалко:жалко:ADV:ROOT:. себя:себя:PRON:obj:1:a ."], None),
    "not_again": ([ASK_A, ASK_B, "@B/2 долго смотрел:смотреть:VERB:ROOT:.:ms в:в:ADP:case:4 окно:окно:NOUN:obl:2:asxI .", DA], None),
    "turns": ([ASK_A, ASK_B, "Быстро:быстро:ADV стемнело:стемнеть:VERB:ROOT:.:xs небо:небо:NOUN:nsubj:1:nsxI вечером:вечер:NOUN:obl:1:ismI дома:дом:NOUN:obl:1:gsmI .", DA], None),
    "not_collective": ([ASK_A, ASK_B, "Солдаты:солдат:NOUN:nsubj:1:npmA стояли:стоять:VERB:ROOT:.:p вечером:вечер:NOUN:obl:1:ismI тихо долго .", DA], None),
    "last": ([ASK_A, "@B/1 вошёл:войти:VERB:ROOT:.:ms .", "@B/1 вышел:выйти:VERB:ROOT:.:ms .", DA], None),
    "nobody": ([DA], None),
    "pronoun": (["@A/1 вошла:войти:VERB:ROOT:.:fs .", "– да , – сказала она:она:PRON:nsubj:4:nsf3 ."], None),
    "pronoun_recent": ([ASK_A, ASK_B], "– да , – сказала она:она:PRON:nsubj:4:nsf3 ."),
    "nominative": (["@A/1 вошла:войти:VERB:ROOT:.:fs .", "Стол:стол:NOUN:nsubj:1:nsmI стоял:стоять:VERB:ROOT:.:ms .", "– да , – сказала Марту:@a:PROPN:nsubj:4:asfA ."], None),
    "generic": ([ASK_A, ASK_B, "– Нет:нет:PART:ROOT:. , – сказала:сказать:VERB:parataxis:1:fs девушка:девушка:NOUN:nsubj:4:nsfA ."], None),
    "sounds": (["– Бах:бах:INTJ:ROOT:. – бах:бах:INTJ:conj:1 ! – бах:бах:INTJ:conj:1 , – сказала @A/9 ."], None),
    "tail": (["– Ты:ты:PRON:nsubj:2:2ns где:где:ADV:ROOT:. , – сказала:сказать:VERB:parataxis:2:fs @A/5 , тебе:ты:PRON:obl:9:2ds видно:видно:ADV:parataxis:5 ? – Да:да:PART:ROOT:. ."], None),
    "after_comma": (["– да , – сказала @A/4 , – пойдём:пойти:VERB:ROOT:.:1p ."], None),
    "after_brackets": (["– да ! – сказала @A/4 . ) – Пойдём:пойти:VERB:ROOT:.:1p ."], None),
    "no_note": (["– Дом:дом:NOUN:ROOT:.:nsmI , – вижу:видеть:VERB:parataxis:1:1s я:я:PRON:nsubj:4:1ns ."], None),
}
#: Phrases of many kinds, a sentence a line.
PORTRAIT = [
    "Старый:старый:ADJ:amod:1:nsm мельник:мельник:NOUN:nsubj:4:nsmA с:с:ADP:case:3 ножом:нож:NOUN:nmod:1:ismI вышел:выйти:VERB:ROOT:.:ms .",
    "Один:один:NUM:nsubj:3:nsm из:из:ADP:case:2 них:они:PRON:nmod:0:gp3 молчал:молчать:VERB:ROOT:.:ms .",
    "Женщина:женщина:NOUN:nsubj:1:nsfA взяла:взять:VERB:ROOT:.:fs дом:дом:NOUN:obj:1:asmI .",
    "Солдаты:солдат:NOUN:nsubj:1:npmA ждали:ждать:VERB:ROOT:.:p себя:себя:PRON:obj:1:a .",
    "Женский:женский:ADJ:amod:1:nsm голос:голос:NOUN:nsubj:2:nsmI звучал:звучать:VERB:ROOT:.:ms .",
    "Кто:кто:PRON:nsubj:1:ns пришёл:прийти:VERB:ROOT:.:ms ? @A/1 , @B/1 .",
    "Она:она:PRON:nsubj:2:nsf3 была:быть:AUX:cop:2:fs врач:врач:NOUN:ROOT:.:nsmA .",
]
