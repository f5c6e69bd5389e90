"""Beginnings of Russian verbs of speech, by kind, and words of the first and second person."""

from __future__ import annotations

import re
from functools import lru_cache

NEUTRAL = "сказа говор молви произн вымолв сообщ заяв объяв добав продолж заключ замет нача повтор уточн поясн объясн напомн подтверд обрат провозгла выгов".split()
REPLY = "ответ отвеч возраз соглас откликн отозв отклик парир отрез поддакн отказ призна".split()
ASK = "спрос спраш вопрош осведом поинтерес попрос прос умол потребов".split()
MANNER = "крик крич закрич вскрич вскрик воскликн восклица шеп прошеп шепн бормот пробормот промыч мыч рявк проревел взрев вопи завоп хрип прохрип буркн бурча ворча проворч шип прошип лепет пролепет визж взвизг протян выпал процед пискн пропищ".split()
THOUGHT = "подум дума реши поду́ма".split()
GESTURE = "усмехн улыбн засмея рассмея вздохн кивн хмыкн фыркн всхлип застон простон перебил прерва позва окликн приказ велел скоманд предлож посовет похвал пошут удив".split()
STEMS = tuple(sorted({*NEUTRAL, *REPLY, *ASK, *MANNER, *THOUGHT, *GESTURE}))
ME_OR_YOU = frozenset("я меня мне мной мы нас нам нами ты тебя тебе тобой вы вас вам вами".split())


def speaks(word: str) -> bool:
    return word.startswith(STEMS)


_WITHIN = re.compile("|".join(STEMS))


@lru_cache(100_000)
def of_speech(lemma: str) -> bool:
    """A stem anywhere in a lemma, so that verbs with a prefix count too."""
    return _WITHIN.search(lemma) is not None
