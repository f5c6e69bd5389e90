"""Who says a line: a fold over the lines of a document, each decision seen by the next ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from causerie.operators.lexicon import speaks
from causerie.operators.replicas import ALTERNATION, ENDING, INSERTION, STARTING, Said, extract
from causerie.operators.tokens import Token, fills_line, line_end, line_start, parenthesized, tokenize
from causerie.shipping import pieces, ship

PRONOUNS = frozenset("он она оно они тот та те кто".split())


@dataclass
class Play:
    """Lines in order with their speakers, and what later decisions ask of them."""

    lines: list[tuple[Said, str | None]] = field(default_factory=list)

    def add(self, said: Said, actor: str | None) -> None:
        self.lines.append((said, actor))

    @property
    def last(self) -> str | None:
        return self.lines[-1][1] if self.lines else None

    @property
    def penult(self) -> str | None:
        """The latest speaker other than the last one."""
        last = self.last
        if last is None:
            return None
        return next((a for _, a in reversed(self.lines) if a is not None and a.lower() != last.lower()), None)


def named_speaker(ts: list[Token], lo: int, hi: int) -> str | None:
    """In the author's words [lo, hi): the name nearest to a verb of speech, else a pronoun nearest to it."""
    verbs = [k for k in range(lo, hi) if ts[k].word and speaks(ts[k].text.lower())]
    if not verbs:
        return None
    first = next((k for k in range(lo, hi) if ts[k].word), lo)

    def names(k: int) -> bool:
        t = ts[k]
        return t.word and t.title and not speaks(t.text.lower()) and t.text.lower() not in PRONOUNS and (k != first or k + 1 in verbs)

    reach = lambda k: min(abs(k - v) for v in verbs)
    found = sorted((k for k in range(lo, hi) if names(k)), key=lambda k: (reach(k), k)) or sorted((k for k in range(lo, hi) if ts[k].text.lower() in PRONOUNS), key=lambda k: (reach(k), k))
    if not found:
        return None
    a = b = found[0]
    while names(b + 1) if b + 1 < hi else False:
        b += 1
    while a - 1 >= lo and names(a - 1):
        a -= 1
    return " ".join(t.text for t in ts[a : b + 1])


def by_spelling(ts: list[Token], lo: int, hi: int, said: Said, play: Play) -> str | None:
    """A pronoun stands for the last named speaker where there is one."""
    found = named_speaker(ts, lo, hi)
    if found and found.lower() in PRONOUNS:
        return next((a for _, a in reversed(play.lines) if a and a.lower() not in PRONOUNS), found)
    return found


def as_decided(k: int, said: list[Said], play: Play, actor: str | None, rule: str) -> tuple[str | None, str]:
    return actor, rule


def attribute(ts: list, said: list[Said], find: Callable = by_spelling, adjust: Callable = as_decided) -> list[tuple[Said, str | None, str]]:
    """(line, speaker or None, rule). The first rule that applies decides; find looks for a speaker in the author's words, adjust may decide otherwise."""
    play, out = Play(), []

    for k, s in enumerate(said):
        name = partial(_name, ts, s, play, find)
        prev = said[k - 1] if k else None
        after = said[k + 1] if k + 1 < len(said) else None
        begin = line_start(ts, s.lo)
        fills = fills_line(ts, s.lo, s.hi)
        breaks = ts[s.lo].line - ts[prev.hi - 1].line if prev else None
        actor, rule = None, "none"
        if prev and play.last is not None and breaks == 0:
            actor, rule = play.last, "same_line"
        elif fills and breaks == 1 and play.penult is not None:
            actor, rule = play.penult, "alternation"
        elif fills and breaks == 1 and s.tag != ALTERNATION and play.last is not None:
            actor, rule = play.last, "goes_on"
        elif s.tag == STARTING and (found := name(begin if begin < s.lo - 1 else line_start(ts, max(0, begin - 1)), s.lo)):
            actor, rule = found, "named_before"
        elif s.tag == ENDING or (s.tag == INSERTION and after):
            lo, hi = (s.hi, line_end(ts, s.hi - 1) + 1) if s.tag == ENDING else (s.hi, after.lo)
            if found := None if s.tag == INSERTION and parenthesized(ts, lo, hi) else name(lo, hi):
                actor, rule = found, "named_after" if s.tag == ENDING else "named_inside"
            elif begin and breaks != 1 and (found := name(ts_line_above(ts, begin), begin)):
                actor, rule = found, "line_above"
            elif play.penult is not None:
                actor, rule = play.penult, "penult"
        elif fills and breaks == 2 and (found := name(ts_line_above(ts, begin), begin)):
            actor, rule = found, "line_above"
        elif fills and play.last is not None:
            actor, rule = play.last, "last"
        actor, rule = adjust(k, said, play, actor, rule)
        play.add(s, actor)
        out.append((s, actor, rule))
    return out


def _name(ts: list, said: Said, play: Play, find: Callable, lo: int, hi: int) -> str | None:
    return find(ts, lo, hi, said, play) if lo < hi else None


def ts_line_above(ts: list[Token], begin: int) -> int:
    return line_start(ts, begin - 1) if begin else begin


SCHEMA = "doc_id string, seq int, start int, end int, replica string, actor string, rule string"
ARROW = pa.schema([("doc_id", pa.string()), ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("replica", pa.string()), ("actor", pa.string()), ("rule", pa.string())])


def rows_of(key: str, text: str) -> list[dict]:
    ts = tokenize(text)
    return [{"doc_id": key, "seq": n, "start": ts[s.lo].start, "end": ts[s.hi - 1].end, "replica": text[ts[s.lo].start : ts[s.hi - 1].end], "actor": a, "rule": r} for n, (s, a, r) in enumerate(attribute(ts, extract(ts)))]


def lines(docs: DataFrame) -> DataFrame:
    """A row a spoken line of docs (doc_id, text) with its speaker and the rule that found it; a document is one row, so nothing is shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            rows = [r for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for r in rows_of(key, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)

    return docs.selectExpr("cast(doc_id AS string) AS doc_id", "text").mapInArrow(run, SCHEMA)
