"""Extraction and attribution over annotated tokens: the automaton and the fold of the plain text, with decisions by syntax."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from causerie.operators import attribution, replicas, speakers
from causerie.operators.replicas import Said
from causerie.operators.syntax import SECOND, Sentences, Word
from causerie.operators.tokens import ENDS, line_end
from causerie.shipping import ship

SURE = ENDS
#: Speech goes on beyond a question within so many tokens if it speaks to somebody.
TAIL = 15


def words_of(t: pa.Table) -> list[Word]:
    """Words in order of i; rows without a text are left out, and heads that aren't there are the word itself."""
    line, out = 1, []
    rows = sorted((r for r in t.to_pylist() if r["text"] and r["i"] is not None), key=lambda r: r["i"])
    at = {r["i"]: n for n, r in enumerate(rows)}
    for n, r in enumerate(rows):
        morph = r["morph"]
        out.append(Word(n, r["start"], r["end"], r["text"], bool(r["newline"]), r["lemma"] or r["text"].lower(), r["pos"] or "X", r["dep"] or "dep", at.get(r["head"], n), dict(morph) if morph else {}, r["ent"], line))
        line += out[-1].newline
    return out


def noted(doc: Sentences):
    """The author's words after a hyphen, told by patterns of word classes and by the tree."""

    def note(ts: list[Word], i: int, start: int) -> tuple[int, int] | None:
        if doc.onomatopoeia(i, start):
            return None
        end = line_end(ts, i) + 1

        def bound(match: tuple[int, int]) -> bool:
            return doc.depends_on((i, match[1]), (start, i)) and ts[i - 1].text not in SURE and not doc.explicit_subject(match)

        m = doc.insertion(i - 1, end)
        if m and doc.authors_note((i + 1, m[1])) and not bound(m):
            return m[1], 1
        m = doc.ending(i - 1, end)
        if m and doc.authors_note((i + 1, m[1])) and not bound(m):
            return end, 0
        return None

    return note


def with_tails(ts: list[Word], said: list[Said]) -> list[Said]:
    """A line that ends in a comma before a hyphen is drawn out to a question or call after it, if that speaks to somebody and is on the line."""
    out = []
    for n, s in enumerate(said):
        if s.hi < len(ts) and ts[s.hi].hyphen and ts[s.hi - 1].text == "," and (n + 1 == len(said) or said[n + 1].lo > s.hi + 1):
            spoken_to = False
            for k in range(s.hi + 1, min(s.hi + 1 + TAIL, len(ts))):
                spoken_to |= ts[k].person in SECOND
                if ts[k].newline:
                    break
                if ts[k].hyphen and ts[k - 1].text[:1] in "?!" and spoken_to:
                    s = Said(s.lo, k, s.tag)
                    break
        out.append(s)
    return out


def rows_of(key: str, t: pa.Table) -> list[dict]:
    words = words_of(t)
    doc = Sentences(words)
    told = speakers.Fold(doc, with_tails(words, replicas.extract(words, noted(doc))))()
    return [{"doc_id": key, "seq": n, "start": words[s.lo].start, "end": words[s.hi - 1].end, "replica": doc.shown((s.lo, s.hi)), "actor": doc.shown(a) if a else None, "rule": r} for n, (s, a, r) in enumerate(told)]


PHRASES = "doc_id string, i int, sentence int, chunk string, phrase string, key string, gender string, person boolean, reference boolean, vague boolean, indefinite boolean, generic boolean, collective boolean, inanimate boolean, named boolean"
NOTED = "doc_id string, i int, pattern string, note string, by_author boolean"
DOERS = "doc_id string, sentence int, verb int, candidate int, score int, best boolean"
#: Arrow's types of the columns above.
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _by_document(tokens: DataFrame, schema: str, f: Callable[[Sentences], Iterable[tuple]]) -> DataFrame:
    """Rows that f makes of each annotated document. One shuffle by doc_id."""
    ship(tokens.sparkSession)
    fields = [c.split() for c in schema.split(", ")]
    arrow = pa.schema([(n, _TYPES[k]) for n, k in fields])

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = list(f(Sentences(words_of(t))))
        cols = list(zip(*rows)) or [()] * (len(fields) - 1)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), *(pa.array(c, x.type) for c, x in zip(cols, list(arrow)[1:]))], schema=arrow)

    return tokens.groupBy("doc_id").applyInArrow(fold, schema)


def phrases(tokens: DataFrame) -> DataFrame:
    """A row a word with the number of its sentence, its noun phrase (chunk), the whole phrase by which somebody is shown, and what that tells; see Sentences."""

    def rows(doc: Sentences) -> Iterator[tuple]:
        for w in doc.words:
            if w.word:
                p, s = doc.phrase(w.i), bisect_right(doc.sentences, w.i)
                told = (doc.human(p), doc.refers(p), doc.vague(p), doc.indefinite(p), doc.generic(p), doc.collective(p), doc.inanimate(p), doc.named(p))
                yield w.i, s, doc.shown(doc.chunk(w.i)), doc.shown(p), doc.key(p), doc.gender(doc.chunk(w.i)), *told

    return _by_document(tokens, PHRASES, rows)


def notes(tokens: DataFrame) -> DataFrame:
    """A row a hyphen after a mark from which one of the patterns of notes fits: the pattern's kind, the note without marks at its ends, and whether it tells of who speaks."""

    def rows(doc: Sentences) -> Iterator[tuple]:
        for w in doc.words[1:]:
            if w.hyphen and doc.words[w.i - 1].breaks and not doc.words[w.i - 1].newline:
                end = doc.on_to_line_end(w.i) + 1
                for kind, m in (("insertion", doc.insertion(w.i - 1, end)), ("ending", doc.ending(w.i - 1, end))):
                    if m:
                        lo, hi = doc.trimmed((w.i + 1, m[1]))
                        yield w.i, kind, doc.shown((lo, hi)) if lo < hi else "", doc.authors_note((w.i + 1, m[1]))

    return _by_document(tokens, NOTED, rows)


def candidates(tokens: DataFrame) -> DataFrame:
    """A row a word that may be the one who acts, by sentence and verb, with its score among those of the sentence."""

    def rows(doc: Sentences) -> Iterator[tuple]:
        for n, lo in enumerate(doc.sentences):
            found = [(v, k) for v in doc.top_verbs(doc.sentence(lo), (0, 0)) for k in doc.candidates(v, (0, 0))]
            words = [k for _, k in found]
            any_human, best = any(doc.human(doc.phrase(k)) for k in words), doc.best(words)
            for v, k in found:
                yield n + 1, v, k, doc.score(k, any_human), k == best

    return _by_document(tokens, DOERS, rows)


def lines(tokens: DataFrame) -> DataFrame:
    """A row a spoken line of annotated documents (syntax.TOKENS) with its speaker and rule. One shuffle by doc_id; a document is folded in one task."""
    ship(tokens.sparkSession)

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(rows_of(key[0].as_py(), t), schema=attribution.ARROW)

    return tokens.groupBy("doc_id").applyInArrow(fold, attribution.SCHEMA)
