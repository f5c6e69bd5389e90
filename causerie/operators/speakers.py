"""Who says a line of an annotated document: a search for those meant in the author's words, and the rules that say where to look."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from heapq import merge

from causerie.operators.replicas import ALTERNATION, ENDING, INSERTION, STARTING, Said
from causerie.operators.syntax import FIRST, SECOND, VOICE, Sentences, Span, Word

#: For a reference so many stretches of the author's words are searched, from the nearest upward.
REGIONS = 4
#: A chain of references is followed for so many steps.
CHAIN = 100
#: A line between two spoken ones tells of a speaker if it has a name, or so many words with a meaning.
CONTENT = 5
#: A line above that tells at length of the one who spoke.
LONG_INTRO = 50


class Cast:
    """Lines in order with their speakers (spans, or None), and what later decisions ask of them; each question is answered without going through all lines."""

    def __init__(self, doc: Sentences) -> None:
        self.doc = doc
        self.lines: list[tuple[Said, Span | None]] = []
        self.bound: dict[int, Span | None] = {}
        self.pending: Said | None = None
        self._last: Span | None = None
        self._other: Span | None = None
        self._recent: dict[Span, None] = {}
        self._keys: set[str] = set()
        self._named: Span | None = None
        self._by_lemma: dict[tuple[str, str], Span] = {}

    def add(self, said: Said, actor: Span | None, chain: list[int]) -> None:
        """chain: references by way of which the speaker was found; they stand for them from now on."""
        self.pending = None
        self.lines.append((said, actor))
        self.bound.update(dict.fromkeys(chain, actor))
        if actor is None:
            return
        if self._last is not None and self.doc.key(actor, False) != self.doc.key(self._last, False):
            self._other = self._last
        self._last = actor
        self._recent.pop(actor, None)
        self._recent[actor] = None
        self._keys.add(self.doc.key(actor))
        if self.doc.named(actor):
            self._named = actor
        root = self.doc.root(actor)
        if root.pos == "PROPN" and root.nominative:
            self._by_lemma["name", root.lemma] = actor
        if root.pos == "NOUN" and root.oblique:
            self._by_lemma["oblique", root.lemma] = actor

    @property
    def last(self) -> Span | None:
        return self.lines[-1][1] if self.lines and self.pending is None else None

    @property
    def last_said(self) -> Span | None:
        said = self.pending or (self.lines[-1][0] if self.lines else None)
        return (said.lo, said.hi) if said else None

    @property
    def penult(self) -> Span | None:
        """The latest speaker other than the last one; nobody if the last one isn't known."""
        return self._other if self.last is not None else None

    def recent(self) -> Iterator[Span]:
        """Different speakers, the latest first."""
        return reversed(self._recent)

    @property
    def named(self) -> Span | None:
        return self._named

    def knows(self, actor: Span | None) -> bool:
        return actor is not None and self.doc.key(actor) in self._keys

    def latest(self, kind: str, lemma: str) -> Span | None:
        """The latest speaker whose root is a name in the nominative, or a noun in another case, of a lemma."""
        return self._by_lemma.get((kind, lemma))

    def spans_upward(self, extra: list[Span]) -> Iterator[Span]:
        spoken = [(self.pending.lo, self.pending.hi)] if self.pending else []
        lines = ((s.lo, s.hi) for s, _ in reversed(self.lines))
        return merge(sorted(spoken + extra, reverse=True), lines, key=lambda s: -s[0])


class Names:
    """Names in the nominative and nouns in other cases, by lemma and beginning, with where they are."""

    def __init__(self, doc: Sentences) -> None:
        self.by_lemma: dict[str, list[int]] = defaultdict(list)
        self.by_beginning: dict[str, list[int]] = defaultdict(list)
        self.oblique: dict[str, list[int]] = defaultdict(list)
        for w in doc.words:
            if w.pos == "PROPN" and w.nominative:
                self.by_lemma[w.lemma].append(w.i)
                low = w.text.lower()
                for k in range(2, len(low) + 1):
                    self.by_beginning[low[:k]].append(w.i)
            elif w.pos == "NOUN" and w.oblique:
                self.oblique[w.lemma].append(w.i)

    @staticmethod
    def nearest(places: list[int], span: Span) -> int | None:
        """The last before a span, else the first after it."""
        k = bisect_left(places, span[0])
        if k:
            return places[k - 1]
        k = bisect_left(places, span[1])
        return places[k] if k < len(places) else None

    def find(self, name: Word, span: Span) -> int | None:
        """By lemma, then by all of the name but its last letter."""
        stem = name.text.lower()[:-1] if len(name.text) > 2 else ""
        found = self.nearest(self.by_lemma.get(name.lemma, []), span)
        return found if found is not None else self.nearest(self.by_beginning.get(stem, []), span)


class Search:
    """Finds who is meant in a stretch of the author's words, for a line about to get its speaker."""

    def __init__(self, doc: Sentences, cast: Cast) -> None:
        self.doc, self.cast = doc, cast
        self._memo: dict[tuple, tuple[Span | None, tuple[int, ...]]] = {}

    @cached_property
    def names(self) -> Names:
        return Names(self.doc)

    def fresh(self) -> None:
        """Forget what was found for another line."""
        self._memo.clear()

    # who a phrase stands for

    def in_nominative(self, actor: Span, force: bool = False) -> Span:
        """A name as it is in the nominative elsewhere: of an earlier speaker, in the text before or in the text after; force: the text goes first."""
        root = self.doc.root(actor)
        if not root.named:
            return actor
        if not force and root.dep in ("nmod", "nmod:poss", "appos") and self.doc.words[root.head].pos == "NOUN":
            return actor
        low = root.text.lower()
        if root.nominative and low == root.lemma.lower() and low[-1:] not in ("и", "ы"):
            return actor
        found = self.names.find(root, actor)
        if not force or found is None:
            known = self.cast.latest("name", root.lemma)
            if known is not None:
                return known
        return actor if found is None else (found, found + 1)

    def generic_case(self, actor: Span) -> Span:
        """A general noun for a person stands for an earlier one of its lemma in another case, a speaker or a phrase."""
        root = self.doc.root(actor)
        if not (root.pos == "NOUN" and root.animate and self.doc.generic(actor)):
            return actor
        known = self.cast.latest("oblique", root.lemma)
        if known is not None:
            return known
        places = self.names.oblique.get(root.lemma, [])
        k = bisect_left(places, actor[0])
        return self.doc.phrase(places[k - 1]) if k else actor

    def recent(self, reference: int) -> Span | None:
        """The latest speaker that agrees with a reference, with a name if possible; the only one with a name if just one has any."""
        other, only, keys = None, None, []
        for actor in self.cast.recent():
            if self.doc.refers(actor):
                continue
            named = self.doc.named(actor)
            if self.doc.aligned(reference, self.doc.root(actor).i):
                if named:
                    return actor
                other = other or actor
            if named and (key := self.doc.key(actor)) not in keys:
                keys.append(key)
                only = only or actor
                if len(keys) > 1:
                    break
        return only if len(keys) == 1 else other

    def antecedent(self, span: Span, reference: int) -> Span | None:
        """In a stretch, from its end: a phrase with a name in the nominative; any name; an animate noun or capital adjective in the nominative."""
        doc = self.doc
        fit = [doc.phrase(w.i) for w in reversed(doc.cut(span)) if w.pos in ("PROPN", "NOUN", "ADJ") and doc.aligned(reference, w.i)]
        tests = (
            lambda w: w.named and not w.oblique,
            lambda w: w.named,
            lambda w: not w.oblique and ((w.pos == "NOUN" and w.animate) or (w.pos == "ADJ" and w.title)),
        )
        return next((p for test in tests for p in fit if any(map(test, doc.cut(p)))), None)

    def regions(self, extra: list[Span]) -> Iterator[Span]:
        """The author's words between lines and other bounds, cut into sentences, from the nearest upward."""
        doc, starts = self.doc, self.doc.sentences
        bounds = self.cast.spans_upward(extra)
        upper = next(bounds, None)
        while upper is not None:
            lower = next(bounds, None)
            lo, hi = doc.trimmed(((lower or (0, 0))[1], upper[0])) if (lower or (0, 0))[1] < upper[0] else (0, 0)
            if lo < hi:
                cuts = [lo, *starts[bisect_right(starts, lo) : bisect_left(starts, hi)], hi]
                yield from reversed(list(zip(cuts, cuts[1:])))
            upper = lower

    # the search

    def __call__(self, span: Span, said: Span, chain: list[int], recent: bool = False) -> Span | None:
        """The speaker; chain takes the references by way of which they were found. recent: only somebody of whom the stretch tells as one who acts or speaks."""
        doc, cast = self.doc, self.cast
        if span[0] >= span[1]:
            return None
        reference = chain[-1] if chain else None
        agrees = (lambda i: doc.aligned(reference, i)) if reference is not None else (lambda i: True)
        verbs = doc.top_verbs(span, said)
        every = [k for v in verbs for k in doc.candidates(v, said)]
        found = self._fit(span, [k for k in every if agrees(k)], recent)
        done = lambda p: self._settle(p, span, said, recent)
        word = doc.words.__getitem__

        pronouns = [k for k in found if word(k).pronoun_like and word(k).subject and word(word(k).head).dep in ("ROOT", "parataxis")]
        if pronouns:
            others = [doc.phrase(k) for k in found if not word(k).reference]
            if others and not any(doc.animate_noun(p) or doc.named(p) for p in others):
                return done(doc.phrase(pronouns[0]))
            if not any(map(doc.human, others)):
                if (who := self._for_pronoun(pronouns[0], said, recent)) is not None and (doc.human(who) or doc.named(who)):
                    return self.in_nominative(who, force=True)

        speaking = [k for k in found if word(k).subject and word(word(k).head).speech and word(k).pos in ("NOUN", "PROPN", "PRON", "DET", "ADJ", "NUM")]
        if (best := doc.best(speaking)) is not None:
            return done(doc.phrase(best))

        exact = {doc.root(doc.chunk(k)).lemma: k for k in found if not word(k).reference and (word(k).subject or word(k).ent)}
        if len(exact) == 1:
            k = next(iter(exact.values()))
            who = doc.phrase(k)
            if who == cast.last:
                if cast.last_said and not doc.apart(cast.last_said, said):
                    found.remove(k)
            elif all(word(c).reference for c in every[: every.index(k)]):
                return done(who)

        strong = any(word(k).subject and not word(k).reference for k in found)
        references = [] if strong and reference is None else [k for k in found if word(k).reference]
        if reference is None and len(references) == 1 and word(references[0]).person in FIRST + SECOND and cast.last_said and doc.breaks(cast.last_said, said) == 1 and cast.penult:
            chain += references
            return cast.penult
        fit_verbs = [v for v in verbs if agrees(v)]
        if references:
            todo = references + fit_verbs
        elif any(not word(k).reference for k in found):
            todo = []
        else:
            todo = [v for v in fit_verbs if not set(doc.children[v]) & set(found) and word(v).morph.get("Gender") != "Neut"]
        who, hit = self._stands_for(todo, span, said, chain, reference)
        if hit:
            return who if hit == "bound" else done(who)

        if found:
            if reference is None:
                return done(doc.phrase(doc.best(found)))
            known = [k for k in found if not word(k).reference]
            if known:
                who = doc.phrase(doc.best(known))
                if who != cast.last or doc.breaks((known[0], known[0] + 1), (chain[0], chain[0] + 1)) >= 2:
                    return done(who)
        return done(doc.phrase(reference)) if reference is not None else None

    def _fit(self, span: Span, found: list[int], recent: bool) -> list[int]:
        word = self.doc.words.__getitem__
        heads = [w for w in self.doc.cut(span) if w.dep == "ROOT"]
        if heads and all(w.morph.get("Gender") == "Neut" for w in heads):
            return []  # of a situation, not of somebody
        found = [k for k in found if not word(k).reflexive] or found
        if recent:
            found = [k for k in found if not (word(k).pronoun_like and word(k).subject and word(word(k).head).dep not in ("ROOT", "parataxis"))]
        return found

    def _for_pronoun(self, k: int, said: Span, recent: bool) -> Span | None:
        above = self.doc.above(said[0]) if recent else (0, 0)
        return (self.antecedent(above, k) if above[0] < above[1] else None) or self.recent(k)

    def _stands_for(self, todo: list[int], span: Span, said: Span, chain: list[int], reference: int | None) -> tuple[Span | None, str]:
        """(who a reference stands for, how it was found: "bound" before, "above" in the author's words, or "" for not at all)."""
        doc, ahead = self.doc, self.regions(([] if reference is not None else [said]) + [span])
        seen: list[Span] = []
        if len(chain) >= CHAIN:
            return None, ""
        for k in todo:
            if self.cast.bound.get(k) is not None:
                return self.cast.bound[k], "bound"
            tried, who, n = 0, None, 0
            while tried < REGIONS:
                if n == len(seen):
                    region = next(ahead, None)
                    if region is None:
                        break
                    seen.append(region)
                region, n = seen[n], n + 1
                if k <= region[1] or (reference is not None and reference <= region[1]):
                    continue
                tried += 1
                who = self._above(region, said, chain, k)
                if who is not None and who[0] != k:
                    there = doc.phrase(who)
                    if doc.words[k].pos != "PRON" or doc.human(there) or doc.named(there) or any(w.lemma == VOICE for w in doc.cut(there)):
                        return there, "above"
                del chain[self._length :]
            else:
                continue
            if reference is not None and who is not None and doc.words[reference].lemma == doc.root(who).lemma:
                return doc.phrase(who), "above"
        return None, ""

    _length = 0

    def _above(self, region: Span, said: Span, chain: list[int], k: int) -> Span | None:
        """The search in a region for a reference; the same question is answered once a line."""
        at = len(chain)
        key = (region, k, chain[0] if chain else k)
        if key not in self._memo:
            longer = [*chain, k]
            who = self(region, said, longer)
            self._memo[key] = who, tuple(longer[at:])
        who, more = self._memo[key]
        self._length = at
        chain += more
        return who

    def _settle(self, actor: Span | None, span: Span, said: Span, recent: bool) -> Span | None:
        """A candidate made a speaker, or dismissed."""
        if actor is None:
            return None
        doc, cast = self.doc, self.cast
        words = doc.cut(actor)
        if not doc.root(actor).named and doc.named(actor) and not any(w.pos == "NOUN" for w in words):
            name = next(w for w in words if w.named)
            actor = name.i, name.i + 1
        actor = self.in_nominative(actor)
        root = doc.root(actor)
        if recent:
            told = doc.mentions(span, actor)
            if "subject" not in told and ((root.pos in ("NOUN", "PROPN") and root.oblique) or (span[0] <= actor[0] and actor[1] <= span[1])):
                return None
            if not doc.human(actor):
                like_name = root.pos != "PRON" and root.alpha and root.title and len(root.text) > 1
                if not ("subject" in told and (root.pos in ("ADJ", "NUM", "DET") or like_name)) and not told & {"speech", "copula"}:
                    return None
        if doc.pronoun(actor):
            if (who := self._for_pronoun(root.i, said, recent)) is not None:
                return self.in_nominative(who, force=True)
            if not root.nominative:
                return None
        resolved = self.generic_case(actor)
        if recent and resolved == actor and doc.generic(actor):
            who = self._for_generic(actor, said)
            if who is not None and not (doc.refers(who) or doc.vague_actor(who) or doc.generic(who)):
                return who
        return resolved

    def _for_generic(self, actor: Span, said: Span) -> Span | None:
        doc, cast = self.doc, self.cast
        who = cast.penult if cast.last_said and doc.breaks(cast.last_said, said) == 1 else None
        if who is None:
            who = cast.last
            if who is not None and not doc.named(who):
                who = cast.named or who
        above = doc.above(said[0])
        if who is not None and cast.penult and any(w.lemma == doc.root(actor).lemma for w in doc.cut(above)) and doc.key(cast.penult) != doc.key(who):
            who = cast.penult
        return who


class Fold:
    """The rules, tried in order for each line; what one decides is seen by those after it."""

    def __init__(self, doc: Sentences, said: list[Said]) -> None:
        self.doc, self.said = doc, said
        self.cast = Cast(doc)
        self.search = Search(doc, self.cast)

    def __call__(self) -> list[tuple[Said, Span | None, str]]:
        out = []
        for k, s in enumerate(self.said):
            self.search.fresh()
            self.chain: list[int] = []
            self.cur, self.tag = (s.lo, s.hi), s.tag
            self.prev = (self.said[k - 1].lo, self.said[k - 1].hi) if k else None
            self.prev_tag = self.said[k - 1].tag if k else None
            self.next = (self.said[k + 1].lo, self.said[k + 1].hi) if k + 1 < len(self.said) else None
            actor, rule = self._decide(s)
            self.cast.add(s, actor, self.chain)
            out.append((s, actor, rule))
        return out

    def _find(self, span: Span, recent: bool = True) -> Span | None:
        return self.search(span, self.cur, self.chain, recent)

    def _decide(self, s: Said) -> tuple[Span | None, str]:
        doc, cast, cur, prev = self.doc, self.cast, self.cur, self.prev
        fills = prev is not None and doc.fills_line(cur)
        if prev and doc.lines_of(prev)[1] == doc.lines_of(cur)[0]:
            return cast.last, "same_line"
        if fills and doc.breaks(cur, prev) == 1 and (found := self._next_line()):
            return found
        if fills and doc.breaks(cur, prev) == 1:
            return None, "none"
        if s.tag == STARTING:
            return self._before()
        if s.tag == ENDING:
            return self._around(self._trailing(), "named_after", s)
        if s.tag == INSERTION and self.next:
            between = (cur[1], self.next[0])
            return self._around((0, 0) if doc.bracketed(between) else doc.trimmed(between), "named_inside", s)
        if fills and doc.breaks(cur, prev) == 2 and self._tells(above := doc.above(cur[0])):
            return self._between(above)
        if fills:
            return cast.last, "last"
        return None, "none"

    def _next_line(self) -> tuple[Span | None, str] | None:
        """A line right under the one before."""
        doc, cast, cur, prev = self.doc, self.cast, self.cur, self.prev
        if self.prev_tag == STARTING and doc.voice_intro(prev):
            return cast.last, "voice_intro"
        if self._told_at_length():
            return cast.last, "long_intro"
        if not cast.penult and self.tag != ALTERNATION:
            return cast.last, "goes_on"
        if not cast.penult:
            return self._second_line() if prev[0] > 1 else (None, "none")
        actor, rule = cast.penult, "alternation"
        if doc.imperative(cur) and doc.imperative(prev):
            actor, rule = cast.last, "imperatives"
        above = doc.above(cur[0])
        if self.tag == ALTERNATION and above[0] < above[1] and above != doc.trimmed(prev):
            who = self._find(above)
            if who and doc.key(who) == doc.key(cast.penult) and "speech" not in doc.mentions(above, who) and above[0] <= who[0] and who[1] <= above[1]:
                actor, rule = cast.last, "named_above"
        if doc.has_person(cur, FIRST) and doc.has_person(prev, SECOND) and doc.indefinite(cast.penult) and cast.named and doc.key(cast.named) != doc.key(cast.last):
            actor, rule = cast.named, "named_before_vague"
        return actor, rule

    def _told_at_length(self) -> bool:
        doc, last, prev, cur = self.doc, self.cast.last, self.prev, self.cur
        above = doc.above(cur[0])
        brief = sum(w.alpha for w in doc.cut(cur)) <= 2
        if above[0] >= above[1] or self.prev_tag in (INSERTION, STARTING) or above == prev or not (doc.named(last) and doc.named(above)):
            return False
        asked = doc.words[prev[1] - 1].text.endswith("?") and brief
        return not asked and not (self.tag == ALTERNATION and brief) and sum(w.alpha for w in doc.cut(above)) > LONG_INTRO and "speech" in doc.mentions(above, last)

    def _second_line(self) -> tuple[Span | None, str]:
        """The second line of a play, under the first: whoever is told of above the first."""
        doc, cast, cur, prev = self.doc, self.cast, self.cur, self.prev
        words = doc.cut(cur)
        reflexive = any(w.reflexive for w in words)
        if reflexive and not doc.has_person(cur, FIRST) and words[0].pos != "PRON":
            return cast.last, "reflexive"
        if not any(w.subject for w in words) and (reflexive or doc.has_person(cur, SECOND)):
            return cast.last, "no_subject"
        above = doc.above(prev[0])
        if above[0] < above[1] and doc.lines_of(above) != doc.lines_of(prev) and (who := self._find(above)):
            return who, "above_previous"
        start = max(0, min(prev[0], doc.sentence(prev[0])[0]) - 2)
        lead = doc.trimmed((doc.back_to_line(start), prev[0])) if start < prev[0] else (0, 0)
        parts = [self._clip(x, lead) for x in reversed(doc.sentences_of(lead))]
        if len(parts) > 1:
            parts.append(lead)
        return next((who for x in parts if (who := self._find(x))), None), "before_previous"

    @staticmethod
    def _clip(a: Span, b: Span) -> Span:
        return max(a[0], b[0]), min(a[1], b[1])

    def _acts(self, who: Span, span: Span, *how: str) -> bool:
        return self.doc.human(who) or bool(self.doc.mentions(span, who).intersection(how))

    def _before(self) -> tuple[Span | None, str]:
        """The author's words before a line, of which the nearest sentence with a name decides."""
        doc, cur = self.doc, self.cur
        lo = min(cur[0], doc.sentence(cur[0])[0])
        if cur[0] - lo < 2 < lo and doc.words[lo - 1].newline:
            lo -= 2  # the colon is on the line before
        if lo >= cur[0]:
            lo = max(0, cur[0] - 1)
        lead = (doc.back_to_line(lo), cur[0])
        sentences, fallback = doc.sentences_of(lead), None
        for sentence in reversed(sentences):
            part = self._clip(sentence, lead)
            who = self._find(part)
            if who and (self._acts(who, part, "speech", "copula") or self.cast.knows(who) or (doc.root(who).pos in ("ADJ", "NUM", "DET") and "subject" in doc.mentions(part, who))):
                if doc.named(part):
                    return who, "named_before"
                fallback = fallback or who
        if len(sentences) > 1:
            return (self._find(lead, recent=False) if doc.named(lead) else fallback), "named_before"
        return None, "named_before"

    def _trailing(self) -> Span:
        """The first sentence of what follows a line, to the next line of speech or the end of the line."""
        doc, cur = self.doc, self.cur
        end = max(cur[1], doc.sentence(cur[0])[1])
        if end == cur[1] and end + 1 < len(doc.words):
            end += 1
        if end == cur[1]:
            return 0, 0
        if self.next and doc.breaks(cur, self.next) == 0:
            span = (cur[1], self.next[0])  # an insertion in truth
        else:
            span = (cur[1], doc.on_to_line_end(end - 1) + 1)
        span = doc.trimmed(span)
        return self._clip(doc.sentence(span[0]), span) if span[0] < span[1] else span

    def _around(self, span: Span, rule: str, s: Said) -> tuple[Span | None, str]:
        """The author's words after or inside a line; without anybody in them those of the line above, and else the speakers take turns."""
        doc, cast, cur, prev = self.doc, self.cast, self.cur, self.prev
        penult, last = cast.penult, cast.last
        who = self._find(span)
        if who:
            answers = last and prev and doc.has_person(cur, FIRST) and doc.has_person(prev, SECOND)
            if answers and penult and doc.key(penult) != doc.key(last) and doc.named(penult) and not doc.named(who) and doc.root(who).pos not in ("ADJ", "NUM", "DET"):
                return penult, "answer"
            return who, rule
        above = doc.above(cur[0])
        if above[0] < above[1] and not (prev and doc.lines_of(above) == doc.lines_of(prev)):
            cast.pending = s
            who = self._find(above)
            cast.pending = None
            if who and self._acts(who, above, "speech", "verbal"):
                return who, "line_above"
        return penult, "penult"

    def _tells(self, span: Span) -> bool:
        words = self.doc.cut(span)
        return self.doc.named(span) or sum(w.content for w in words) >= CONTENT

    def _between(self, whole: Span) -> tuple[Span | None, str]:
        """A line of the author's between this line and the one before; its last sentence first."""
        doc, cast, cur = self.doc, self.cast, self.cur
        sentences = doc.sentences_of(whole)
        span = sentences[-1] if len(sentences) > 1 else whole
        last, penult = cast.last, cast.penult
        who, rule = self._find(span), "between"
        animate = doc.animate_noun(whole)
        if who and (not self._acts(who, whole, "speech", "copula") or (animate and not doc.animate_noun(who))):
            fallback = None
            for sentence in reversed(sentences):
                part = self._clip(sentence, whole)
                other = self._find(part)
                if other and (self._acts(other, part, "speech", "copula") or cast.knows(other)):
                    if animate and not doc.animate_noun(other):
                        fallback = fallback or other
                        continue
                    who, rule = other, "between_rescanned"
                    break
            who = who or fallback
        speaks = lambda x: "speech" in doc.mentions(span, x)
        differs = lambda: who and last and doc.key(who) != doc.key(last)
        if differs() and speaks(who) and not any(w.text == ":" for w in doc.cut(span)):
            who, rule = last, "spoke_before"
        if differs() and speaks(last):
            who, rule = last, "last_speaks"
        if differs() and self.tag == ALTERNATION and not doc.has_person(cur, FIRST) and any(w.reflexive for w in doc.cut(cur)) and not speaks(who):
            who, rule = last, "reflexive"
        if who and last and penult and not differs() and not speaks(last) and not any(w.speech for w in doc.cut(span)):
            who, rule = penult, "not_again"
        if not who and self.tag == ALTERNATION and penult:
            who, rule = penult, "turns"
        if who and penult and doc.collective(who):
            who, rule = penult, "not_collective"
        return who, rule
