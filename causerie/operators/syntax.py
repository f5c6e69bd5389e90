"""Operators over tokens that an annotator has given parts of speech, morphology, heads, lemmas and entities.

Annotations come as a table (TOKENS), from whatever annotator filled it; nothing here runs one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from causerie.operators.lexicon import of_speech
from causerie.operators.tokens import BREAKS, CLOSE_QUOTES, ENDS, HYPHENS, OPEN_QUOTES

TOKENS = "doc_id string, i int, start int, end int, text string, newline boolean, lemma string, pos string, dep string, head int, morph map<string,string>, ent string"
NOMINAL = frozenset(["NOUN", "PROPN", "PRON", "NUM"])
NAMING = NOMINAL - {"NUM"}
DOERS = NOMINAL | {"ADJ"}
VERBAL = frozenset(["VERB", "AUX"])
#: What a word that acts or speaks is to its verb.
ACTING = frozenset("nsubj obj acl acl:relcl".split())
MODIFIERS = frozenset("amod appos compound flat nmod".split())
ON_THE_LEFT = frozenset("amod appos det fixed flat goeswith nmod nmod:poss nummod obl".split())
ON_THE_RIGHT = ON_THE_LEFT - {"det"}
#: Forms of the reflexive pronoun.
REFLEXIVE = frozenset("себя себе собой собою".split())
#: Beginnings of lemmas that stand for somebody named elsewhere, and the gender that they imply, if any; the first that fits counts.
REFERRAL = {
    **dict.fromkeys("он тот сам его ему мальчик мужчина мужск парень".split(), "Masc"),
    **dict.fromkeys("она та сама ее её ей дева девочка девушка женщина женск".split(), "Fem"),
    **dict.fromkeys("оно то само существо".split()),
}
REFERRING = tuple(REFERRAL)
#: A voice is told by one of these before it.
TELLING = frozenset(["мужской", "женский", *REFERRAL])
VOICE = "голос"
FIRST, SECOND = ("First", "1"), ("Second", "2")
#: Of hard and soft adjectives: by case, in the singular and plural.
ADJECTIVE_ENDINGS = tuple(f"{vowel}{rest}" for vowels, rests in (("ыи", ("й", "е", "м", "ми")), ("о", ("й", "е", "го", "му", "м")), ("е", ("е", "го", "му", "м")), ("а", ("я",)), ("я", ("я",)), ("ую", ("ю",))) for vowel in vowels for rest in rests)
#: Word classes without a meaning of their own.
EMPTY = frozenset("PUNCT SPACE ADP CCONJ SCONJ PART PRON DET AUX".split())
#: After these a sentence ends.
STOPS = frozenset(".!?‼‽⁇⁈⁉。！．？｡؟")


@dataclass(slots=True, eq=False)
class Word:
    i: int
    start: int
    end: int
    text: str
    newline: bool
    lemma: str
    pos: str
    dep: str
    head: int
    morph: dict[str, str]
    ent: str | None = None
    line: int = 1

    @property
    def alpha(self) -> bool:
        return self.text.isalpha()

    @property
    def punct(self) -> bool:
        return self.pos == "PUNCT" or not any(c.isalnum() for c in self.text)

    @property
    def hyphen(self) -> bool:
        return self.text in HYPHENS

    @property
    def breaks(self) -> bool:
        return self.text in BREAKS or self.text[:1] in "?!"

    @property
    def opens(self) -> bool:
        return self.text in OPEN_QUOTES

    @property
    def closes(self) -> bool:
        return self.text in CLOSE_QUOTES

    @property
    def word(self) -> bool:
        return self.text[:1].isalnum()

    @property
    def non_word(self) -> bool:
        """Punctuation; a line's last token counts as such, whatever it is."""
        return self.punct or self.newline

    @property
    def stop(self) -> bool:
        return self.text in STOPS or (self.text[:1] in "?!" and not self.word)

    @property
    def animate(self) -> bool:
        return self.morph.get("Animacy") == "Anim"

    @property
    def content(self) -> bool:
        return not self.punct and self.pos not in EMPTY

    @property
    def title(self) -> bool:
        return self.text.istitle()

    @property
    def subject(self) -> bool:
        return self.dep.startswith("nsubj")

    @property
    def named(self) -> bool:
        return self.pos == "PROPN" or self.ent == "PER"

    @property
    def copula(self) -> bool:
        return self.dep == "cop" and self.pos == "AUX"

    @property
    def speech(self) -> bool:
        return self.pos in VERBAL and of_speech(self.lemma)

    @property
    def person(self) -> str | None:
        return self.morph.get("Person")

    @property
    def nominative(self) -> bool:
        return self.morph.get("Case") == "Nom"

    @property
    def oblique(self) -> bool:
        return "Case" in self.morph and not self.nominative

    @property
    def reflexive(self) -> bool:
        return self.lemma in REFLEXIVE

    @property
    def reference(self) -> bool:
        """A pronoun, or a general word for a person that isn't itself an animate noun."""
        return self.pos == "PRON" or (self.lemma in REFERRAL and not (self.pos == "NOUN" and self.animate))

    @property
    def human(self) -> bool:
        return self.ent == "PER" or (self.pos in ("NOUN", "PROPN") and self.morph.get("Animacy") == "Anim") or (self.pos == "PRON" and self.person is not None)

    @property
    def adjective_like(self) -> bool:
        return self.alpha and self.text.lower().endswith(ADJECTIVE_ENDINGS)

    @property
    def pronoun_like(self) -> bool:
        return self.pos == "PRON" or (self.pos == "DET" and ("PronType" in self.morph or self.lemma in REFERRAL)) or (self.pos == "ADJ" and self.lemma.startswith("сам"))


def morph_distance(a: Word, b: Word, *features: str) -> int:
    """In how many features two words differ; one that both lack is alike."""
    return sum(a.morph.get(f) != b.morph.get(f) for f in features)


def agrees(reference: Word, target: Word) -> bool:
    return morph_distance(reference, target, "Gender", "Number", "Tense") < 2


Span = tuple[int, int]


@dataclass
class Sentences:
    """A document's words with what follows from their tree."""

    words: list[Word]
    memo: dict = field(default_factory=dict)

    @cached_property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.words]
        for w in self.words:
            if w.head != w.i and 0 <= w.head < len(out):
                out[w.head].append(w.i)
        return out

    def ancestors(self, i: int) -> list[int]:
        seen, out = {i}, []
        while (h := self.words[i].head) not in seen and 0 <= h < len(self.words):
            seen.add(h)
            out.append(h)
            i = h
        return out

    def below(self, i: int) -> set[int]:
        out, todo = set(), list(self.children[i])
        while todo:
            k = todo.pop()
            if k not in out:
                out.add(k)
                todo += self.children[k]
        return out

    def cut(self, span: Span) -> list[Word]:
        return self.words[span[0] : span[1]]

    def text(self, span: Span, source: str) -> str:
        return source[self.words[span[0]].start : self.words[span[1] - 1].end]

    def root(self, span: Span) -> Word:
        """The word of a span that is nearest to the top of its tree, the first of equally near ones; a mark only if there is no word."""
        return min(self.cut(span), key=lambda w: (w.punct, self.depth[w.i]), default=self.words[min(span[0], len(self.words) - 1)])

    @cached_property
    def depth(self) -> list[int]:
        """Number of words above each; a circle of heads counts from where it is entered."""
        out = [-1] * len(self.words)
        for w in self.words:
            path, i = [], w.i
            while out[i] < 0 and i not in path[-1:] and 0 <= self.words[i].head < len(out) and self.words[i].head != i and len(path) <= len(out):
                path.append(i)
                out[i] = 0
                i = self.words[i].head
            base = max(out[i], 0)
            out[i] = base
            for k, j in enumerate(reversed(path)):
                out[j] = base + k + 1
        return out

    @cached_property
    def sentences(self) -> list[int]:
        """Where sentences begin: after a line's last token, or at it if that is a hyphen, and at the first token after an end mark that is no punctuation, or is a hyphen."""
        starts, ended = {0} if self.words else set(), False
        for w in self.words:
            if w.newline:
                starts.add(w.i + (not w.hyphen))
                ended = False
            elif ended and not w.stop and (w.hyphen or not w.punct):
                starts.add(w.i)
                ended = False
            elif w.stop:
                ended = True
        return sorted(x for x in starts if x < len(self.words))

    def sentence(self, i: int) -> Span:
        k = bisect_right(self.sentences, i)
        return self.sentences[k - 1], self.sentences[k] if k < len(self.sentences) else len(self.words)

    def sentences_of(self, span: Span) -> list[Span]:
        """The sentences that a stretch has a part of."""
        out, at = [], span[0]
        while at < span[1]:
            out.append(self.sentence(at))
            at = out[-1][1]
        return out

    def trimmed(self, span: Span) -> Span:
        """Without punctuation, and tokens at a line's end, at its ends."""
        lo, hi = span
        while lo < hi and self.words[lo].non_word:
            lo += 1
        while hi > lo and self.words[hi - 1].non_word:
            hi -= 1
        return lo, hi

    def back_to_line(self, i: int) -> int:
        """The last token of the line before that of i, or 0; i itself if it ends a line."""
        while i > 0 and not self.words[i].newline:
            i -= 1
        return i

    def on_to_line_end(self, i: int) -> int:
        while i < len(self.words) - 1 and not self.words[i].newline:
            i += 1
        return i

    def above(self, i: int) -> Span:
        """The trimmed line before that of i; an empty span if there is none."""
        end = self.back_to_line(i)
        return self.trimmed((self.back_to_line(end - 1), end)) if end else (0, 0)

    def lines_of(self, span: Span) -> Span:
        """Numbers of the lines in which a span begins and ends."""
        return self.words[span[0]].line, self.words[span[1] - 1].line

    def breaks(self, a: Span, b: Span) -> int:
        first, second = (a, b) if b[0] > a[1] else (b, a)
        return self.words[second[0]].line - self.words[max(first[1] - 1, 0)].line

    def fills_line(self, span: Span) -> bool:
        """Does a line end shortly before a span, without a colon, and at its end or shortly after it?"""
        before = self.words[max(0, span[0] - 3) : span[0]]
        after = self.words[span[1] - 1 : span[1] + 3]
        return any(w.newline for w in before) and not any(w.text == ":" for w in before) and any(w.newline for w in after)

    def bracketed(self, span: Span) -> bool:
        near = lambda i, mark: any(w.text == mark for w in self.words[max(0, i - 3) : i + 3])
        return span[0] < span[1] and near(span[0], "(") and near(span[1] - 1, ")")

    def apart(self, a: Span, b: Span) -> bool:
        """Are there words between two spans?"""
        first, second = sorted((a, b))
        lo, hi = self.trimmed((first[1], max(first[1], second[0])))
        return lo < hi

    def shown(self, span: Span) -> str:
        out, at = [], self.words[span[0]].start
        for w in self.cut(span):
            out += [" " * (w.start > at), w.text]
            at = w.end
        return "".join(out)

    @cached_property
    def chunks(self) -> list[Span]:
        """Noun phrases around nominal words, left to right, none overlapping; worked out once a document."""
        out, reached = [], -1
        uniform = lambda a, b: morph_distance(a, b, "Number", "Case", "Voice") == 0
        words, n = self.words, len(self.words)
        for w in words:
            if w.i < reached or w.pos not in NOMINAL:
                continue
            left = min([k for k in self.children[w.i] if k < w.i and words[k].dep in ON_THE_LEFT], default=w.i)
            while left and words[left].pos != "PROPN" and words[left - 1].dep in ON_THE_LEFT and uniform(words[left - 1], words[left]):
                left -= 1
            right, before = w.i, None
            while right != before:
                before = right
                right = max([k for k in self.children[right] if k > right and words[k].dep in ON_THE_RIGHT], default=right)
                if right + 1 >= n:
                    break
                here, after = words[right], words[right + 1]
                if here.pos != "PROPN" and uniform(here, after):
                    right += 1
                elif right + 2 < n and after.pos == "ADP" and after.dep == "case" and words[right + 2].pos in NOMINAL:
                    right += 2
                elif right + 2 < n and (after.pos == "CCONJ" or after.hyphen) and uniform(here, words[right + 2]):
                    right += 2
            if left > reached:
                out.append((left, right + 1))
                reached = right
        return out

    @cached_property
    def chunk_of(self) -> list[Span | None]:
        """The phrase that each word is in, if it lies in one sentence."""
        out: list[Span | None] = [None] * len(self.words)
        for lo, hi in self.chunks:
            if self.sentence(lo) == self.sentence(hi - 1):
                out[lo:hi] = [(lo, hi)] * (hi - lo)
        return out

    def chunk(self, at: int | Span) -> Span:
        """The phrase that holds a word or span, or the one entity in a phrase of more than two words; else the word or span alone."""
        lo, hi = (at, at + 1) if isinstance(at, int) else at
        found = self.chunk_of[lo] if lo < hi else None
        if found is None or hi > found[1]:
            return lo, hi
        if found[1] - found[0] > 2:
            ents = self.entities(found)
            if len(ents) == 1:
                return ents[0]
        return found

    def entities(self, span: Span) -> list[Span]:
        out: list[Span] = []
        for w in self.cut(span):
            if w.ent:
                if out and out[-1][1] == w.i and self.words[w.i - 1].ent == w.ent:
                    out[-1] = (out[-1][0], w.i + 1)
                else:
                    out.append((w.i, w.i + 1))
        return out

    def hyphenated(self, span: Span) -> Span:
        """With the left part of a word that a hyphen begins, and what looks like an adjective before a hyphenated one."""
        lo, hi = span
        with_hyphen = any(w.hyphen for w in self.cut(span))
        if lo < hi and lo and self.words[lo].hyphen:
            lo -= 1
        if with_hyphen and lo and self.words[lo - 1].adjective_like:
            lo -= 1
        return lo, hi

    def settled(self, span: Span) -> Span:
        """With a numeral or determiner of its root before it; the name, or the word that leads, of a hyphenated phrase; the descriptor of a vague one."""
        lo, hi = self.hyphenated(span)
        if lo and (before := self.words[lo - 1]).pos in ("NUM", "DET") and before.dep in ("nummod", "det") and before.head == self.root((lo, hi)).i:
            lo -= 1
        words = self.cut((lo, hi))
        nouns = [w for w in words if w.pos in ("NOUN", "PROPN")]
        if len(nouns) > 1 and any(w.hyphen for w in words):
            left, right = nouns[0], nouns[-1]
            bare = not any(self.words[k].dep in MODIFIERS for k in self.children[left.i])
            if right.named or (right is self.root((lo, hi)) and left.pos == "NOUN" and bare):
                return right.i, right.i + 1
        if self.vague((lo, hi)) and (told := self.descriptor((lo, hi))):
            return told.i, told.i + 1
        return lo, hi

    def phrase(self, at: int | Span) -> Span:
        """The whole phrase for a word or span, by which somebody is shown."""
        return self.settled(self.hyphenated(self.chunk(at)))

    def descriptor(self, span: Span) -> Word | None:
        words, root = self.cut(span), self.root(span)
        told = next((w for w in words if w.dep == "appos" and w.pos in ("NOUN", "PROPN", "ADJ")), None)
        if told is None and root.pos in ("PRON", "NUM", "DET"):
            told = next((w for w in words if w.pos == "ADJ" and morph_distance(w, root, "Gender", "Number") == 0), None)
        return told

    def has_noun(self, span: Span) -> bool:
        return any(w.pos in ("NOUN", "PROPN") for w in self.cut(span))

    def animate_noun(self, span: Span) -> bool:
        return any(w.pos == "NOUN" and w.animate for w in self.cut(span))

    def role(self, span: Span) -> bool:
        """A noun for somebody in particular, in an animate phrase."""
        return any(w.pos == "NOUN" and w.lemma not in REFERRAL and any(x.animate for x in self.cut(self.chunk(w.i))) for w in self.cut(span))

    def vague(self, span: Span) -> bool:
        """A pronoun without a person, or a numeral or determiner, and no noun for somebody."""
        root = self.root(span)
        if root.pos == "PRON" and root.person is None and "Prs" not in root.morph.get("PronType", ""):
            return not self.role(span)
        return root.pos in ("NUM", "DET") and not any(w.pos in ("NOUN", "PROPN") and w.dep not in ("obl", "nmod", "case") for w in self.cut(span))

    def vague_actor(self, span: Span | None) -> bool:
        if span is None:
            return False
        root = self.root(span)
        if root.pos == "ADJ" and not self.has_noun(span):
            return "PronType" in root.morph or "NumType" in root.morph
        return self.vague(span)

    def indefinite(self, span: Span | None) -> bool:
        """A vague actor, or some of many."""
        if span is None:
            return False
        root = self.root(span)
        return self.vague_actor(span) or (root.pos == "NUM" and any(w.dep == "nmod" and w.head == root.i for w in self.cut(span)))

    def generic(self, span: Span | None) -> bool:
        """A noun for any man, woman or being."""
        return span is not None and (root := self.root(span)).pos == "NOUN" and root.lemma.lower().startswith(REFERRING)

    def named(self, span: Span | None) -> bool:
        return span is not None and any(w.named for w in self.cut(span))

    def human(self, span: Span | None) -> bool:
        return span is not None and any(w.human for w in self.cut(span))

    def pronoun(self, span: Span | None) -> bool:
        return span is not None and self.root(span).pronoun_like

    def refers(self, span: Span) -> bool:
        """Does a phrase stand for somebody named elsewhere? A voice with a telling adjective does."""
        words = self.cut(span)
        if any(w.pos == "PRON" for w in words):
            return True
        if any(w.lemma in REFERRAL for w in words):
            return not self.animate_noun(span)
        return any(w.dep == "amod" and w.lemma in TELLING and self.words[w.head].lemma == VOICE for w in self.cut(self.chunk(span)))

    def key(self, span: Span | None, hyphens: bool = True) -> str:
        """By this a speaker is known again; hyphens: a hyphenated phrase by its root."""
        if span is None:
            return ""
        words, root = self.cut(span), self.root(span)
        lemmas = lambda ws: " ".join(w.lemma.lower() for w in ws)
        if any(w.named for w in words):
            return lemmas(w for w in words if w.pos == "PROPN") or lemmas(words)
        if root.pos == "PRON":
            return lemmas(words)
        if hyphens and root.pos in ("NOUN", "PROPN") and any(w.hyphen for w in words):
            return root.lemma.lower()
        return self.shown(span).lower()

    def mentions(self, span: Span, actor: Span | None) -> set[str]:
        """How a stretch tells of somebody, by lemma: as subject; of a verb (verbal), of speech (speech), of a word with a copula (copula); appos: as what explains a subject."""
        out: set[str] = set()
        lemmas = {w.lemma for w in self.cut(actor) if w.alpha} if actor else set()
        for w in self.cut(span) if lemmas else ():
            if w.lemma in lemmas and 0 <= w.head < len(self.words):
                head = self.words[w.head]
                if w.subject:
                    out.add("subject")
                    if head.pos == "VERB" and not head.copula:
                        out.add("verbal")
                    if head.pos in ("ADJ", "NOUN", "PROPN") and any(self.words[k].copula for k in self.children[head.i]):
                        out.add("copula")
                elif w.dep == "appos" and head.subject:
                    out |= {"subject", "appos"}
            if w.pos == "VERB" and w.speech and any(self.words[k].subject and self.words[k].lemma in lemmas for k in self.children[w.i]):
                out.add("speech")
        return out

    def voice_intro(self, span: Span) -> bool:
        """Is a voice spoken of before a line, or in the line above it?"""
        return any(w.lemma == VOICE for w in self.cut((self.back_to_line(span[0]), span[0])) + self.cut(self.above(span[0])))

    def inanimate(self, span: Span) -> bool:
        found = {w.morph.get("Animacy") for w in self.cut(span)}
        return "Inan" in found and "Anim" not in found

    def collective(self, span: Span) -> bool:
        root = self.root(span)
        return (root.lemma == VOICE and root.morph.get("Number") == "Plur") or any(w.morph.get("Number") == "Plur" for w in self.cut(span) if w.alpha)

    def has_person(self, span: Span, person: tuple[str, ...]) -> bool:
        return any(w.alpha and w.person in person for w in self.cut(span))

    def imperative(self, span: Span) -> bool:
        return any(w.pos in VERBAL and w.morph.get("Mood") == "Imp" for w in self.cut(span))

    def brief(self, span: Span) -> bool:
        return sum(w.alpha for w in self.cut(span)) <= 2

    def gender(self, span: Span) -> str | None:
        """Of one word its own; of more that which a general word implies, else the most frequent one, the first seen of equally frequent ones."""
        words = self.cut(span)
        if len(words) == 1:
            return words[0].morph.get("Gender")
        implied = next((REFERRAL[k] for w in reversed(words) for k in REFERRING if w.lemma.startswith(k)), None)
        return implied or Counter(w.morph.get("Gender") for w in words).most_common(1)[0][0]

    def aligned(self, target: int, other: int) -> bool:
        """May a word stand for another, by gender and number?"""
        a, b = self.words[target], self.words[other]
        g = self.gender(self.chunk(target))
        if g:
            return self.gender(self.chunk(other)) == g and morph_distance(a, b, "Number") == 0
        return agrees(b, a) or (morph_distance(a, b, "Number") == 0 and agrees(self.words[b.head], a))


    def tells_of_speech(self, span: Span) -> bool:
        """A subject or object of a verb of speech, a subject above one, or a voice with a telling adjective."""
        for w in self.cut(span):
            head = self.words[w.head] if 0 <= w.head < len(self.words) else w
            if head is not w and head.pos == "VERB" and head.speech and w.pos not in ("SPACE", "PUNCT") and w.dep in ACTING:
                return True
            if w.dep == "nsubj" and any(self.words[k].pos == "VERB" and self.words[k].speech for k in self.below(w.head)):
                return True
            if w.lemma == VOICE and any(self.words[k].dep == "amod" and self.words[k].lemma in TELLING for k in self.children[w.i]):
                return True
        return False

    def depends_on(self, match: Span, phrase: Span) -> bool:
        """Does some word of match hang from words of the phrase alone?"""
        inside = {w.i for w in self.cut(phrase) if w.alpha}
        return any(w.alpha and w.dep != "parataxis" and (up := self.ancestors(w.i)) and inside.issuperset(up) for w in self.cut(match))

    def explicit_subject(self, span: Span) -> bool:
        return any(w.subject and w.pos in NAMING for w in self.cut(span))

    def authors_note(self, span: Span) -> bool:
        """Are these the author's words about who speaks?"""
        lo, hi = span
        if hi - lo >= 2 and self.words[hi - 1].text.istitle() and self.words[hi - 2].hyphen:
            hi -= 2
        while lo < hi and not self.words[lo].alpha:
            lo += 1
        while hi > lo and not self.words[hi - 1].alpha:
            hi -= 1
        if lo == hi:
            return False
        if self.tells_of_speech((lo, hi)):
            return True
        words = [w for w in self.cut((lo, hi)) if w.alpha]
        if any(w.person in FIRST + SECOND for w in words) or len(words) > 30:
            return False
        return any(w.pos in VERBAL for w in words) and any(w.pos in NAMING for w in words)

    def onomatopoeia(self, i: int, start: int) -> bool:
        """Is the hyphen at i within a run of sounds, as in "бах – бах! – бах", of a line spoken from start on?"""
        if i - 3 < start or i + 1 >= len(self.words) or self.words[i - 1].text != "!" or self.words[i + 1].text.istitle():
            return False
        sound, hyphen = self.words[i - 2], self.words[i - 3]
        before = self.words[i - 4] if i - 4 >= start else None
        return hyphen.hyphen and (sound.pos not in NAMING or (before is not None and sound.lemma == before.lemma))

    def codes(self, span: Span) -> str:
        """A letter a word, by which of the classes of NOTE_CLASSES it is in."""
        return "".join(map(_code, self.cut(span)))

    def insertion(self, at: int, end: int) -> Span | None:
        """The shortest note from the mark at on after which speech goes on; see NOTES. The word after its last hyphen is not part of it."""
        codes = self.codes((at, end))
        for k in range(3, len(codes)):
            if self.words[at + k - 1].hyphen and any(p.fullmatch(codes, 0, k + 1) for name, p in NOTES.items() if name.startswith("insertion")):
                return at, at + k
        return None

    def ending(self, at: int, end: int) -> Span | None:
        """The note from the mark at on to the end of the line."""
        codes = self.codes((at, end))
        return (at, end) if any(p.fullmatch(codes) for name, p in NOTES.items() if name.startswith("ending")) else None

    def top_verbs(self, span: Span, replica: Span) -> list[int]:
        out: list[int] = []
        for w in self.cut(span):
            hung = w.dep in ("ROOT", "acl", "parataxis") or replica[0] <= w.head < replica[1] or w.head in out
            if w.pos == "VERB" and w.dep != "advcl" and hung:
                out += [k for k in self.children[w.i] if self.words[k].pos in VERBAL] if w.text.endswith("вшись") else [w.i]
            elif w.copula:
                out.append(w.head)
        return out

    def candidates(self, verb: int, replica: Span) -> list[int]:
        out, under = [], self.children[verb]
        has_subject = any(self.words[k].subject for k in under)
        for k in under:
            w = self.words[k]
            if replica[0] <= k < replica[1] or w.punct:
                continue
            if w.dep == "obl" and (det := next((c for c in self.children[k] if self.words[c].pos == "DET"), None)) is not None:
                out.append(det)
            if w.subject or (w.dep == "obj" and agrees(self.words[verb], w)) or (w.dep == "obl" and w.pos == "PROPN" and has_subject) or w.reference:
                out.append(k)
        return out

    def score(self, i: int, any_human: bool) -> int:
        """How likely a word is the one who speaks, by its phrase."""
        w, span = self.words[i], self.phrase(i)
        top, person = self.root(span).pos, self.human(span)
        nominal = w.pos in ("PROPN", "NOUN")
        weights = (
            (2, w.subject),
            (-2, w.dep == "obj"),
            (-1, w.dep == "obl"),
            (-3, nominal and not w.nominative),
            (3, not w.reference),
            (3, w.named or any(x.ent == "PER" for x in self.cut(span))),
            (3 if top == "ADJ" else 1, w.dep == "appos"),
            (2, top == "ADJ" and w.pos in ("NUM", "PRON", "DET")),
            (-2, w.pos == "PRON"),
            (-5, w.reflexive),
            (2, person),
            (-2, any_human and not person),
            (-6, any_human and self.inanimate(span)),
        )
        return self.length(span) + sum(n for n, holds in weights if holds)

    def length(self, span: Span) -> int:
        return min(3, sum(x.alpha for x in self.cut(span)))

    def best(self, found: list[int]) -> int | None:
        """The highest score; of equal ones the longer phrase, then the leftmost. If any is a person, things are no candidates."""
        any_human = any(self.human(self.phrase(i)) for i in found)
        if any_human:
            found = [i for i in found if self.human(self.phrase(i)) or not self.inanimate(self.phrase(i))]
        return max(found, key=lambda i: (self.score(i, any_human), self.length(self.phrase(i)), -i), default=None)


#: What is asked of a token in the patterns of notes.
NOTE_CLASSES = {
    "ends_line": lambda w: w.newline,
    "end": lambda w: w.text in ENDS or w.text[:1] in "?!",
    "dots": lambda w: w.text in ("…", "..."),
    "comma": lambda w: w.text == ",",
    "semicolon": lambda w: w.text == ";",
    "colon": lambda w: w.text == ":",
    "bracket": lambda w: w.text == ")",
    "hyphen": lambda w: w.hyphen,
    "verb": lambda w: w.pos in VERBAL,
    "doer": lambda w: w.pos in DOERS and w.morph.get("Case") in ("Nom", "Acc", "Dat") and w.person not in SECOND,
    "title": lambda w: w.title,
}
_BASE = 0x4E00


def _code(w: Word) -> str:
    return chr(_BASE + sum(1 << k for k, holds in enumerate(NOTE_CLASSES.values()) if holds(w)))


def _any(*names: str, without: str = "", and_: str = "") -> str:
    """A set of all letters of tokens in any of the classes, in and_ and not in without."""
    bit = {name: 1 << k for k, name in enumerate(NOTE_CLASSES)}
    letters = [c for c in range(1 << len(bit)) if (not names or any(c & bit[n] for n in names)) and not (without and c & bit[without]) and (not and_ or c & bit[and_])]
    return "[" + "".join(chr(_BASE + c) for c in letters) + "]"


def _notes() -> dict[str, re.Pattern]:
    """Patterns of the author's words from the mark before the hyphen on, by name: endings run to the line's end; insertions to the hyphen and word with which speech
    goes on, a capital one after an end mark (1), a small one after a comma (2). The verb comes before the doer (_1) or after (_2).
    """
    filler, hyphen, verb, doer = _any(without="ends_line") + "*", _any("hyphen"), _any("verb"), _any("doer") + "+"
    orders = {"1": filler.join(["", verb, doer, ""]), "2": filler.join(["", doer, verb, ""])}
    shapes = {
        "ending": (_any("end", "comma"), _any("end", and_="ends_line")),
        "insertion_1": (_any("end", "comma"), _any("end", "semicolon", "colon") + _any("bracket") + "*" + hyphen + _any("title")),
        "insertion_2": (_any("comma", "dots"), _any("comma", "semicolon") + hyphen + _any(without="title")),
    }
    return {f"{shape}_{n}": re.compile(first + hyphen + order + last) for shape, (first, last) in shapes.items() for n, order in orders.items()}


NOTES = _notes()
