"""Spoken lines of prose: an automaton over the tokens of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from causerie.operators.lexicon import ME_OR_YOU, speaks
from causerie.operators.tokens import Token, line_end, tokenize
from causerie.shipping import ship

ALTERNATION, INSERTION, STARTING, ENDING = "alternation", "before_insertion", "after_starting", "before_ending"
#: Author's words inside a line are at most this many.
LONGEST_NOTE = 30


Resumed = tuple[int, int] | None


@dataclass(slots=True)
class Said:
    lo: int
    hi: int  # tokens [lo, hi)
    tag: str | None = None


def authors_note(ts: list[Token], lo: int, hi: int) -> bool:
    """Words of the author about who speaks: a verb of speech, nobody's own "I" or "you", and not too long."""
    words = [t.text.lower() for t in ts[lo:hi] if t.word]
    return 0 < len(words) <= LONGEST_NOTE and any(map(speaks, words)) and not any(w in ME_OR_YOU for w in words)


def after_dash(ts: list[Token], i: int, start: int) -> Resumed:
    """For a hyphen at i after a break mark inside a line spoken from start on: (first token of the speech after a note, or the line's end; 1 if speech goes on)."""
    end = line_end(ts, i) + 1
    for k in range(i + 2, end):
        if ts[k].hyphen and ts[k - 1].breaks and k + 1 < end and authors_note(ts, i + 1, k):
            return k + 1, 1
    return (end, 0) if authors_note(ts, i + 1, end) else None


def extract(ts: list, note: Callable = after_dash) -> list[Said]:
    """The spoken lines of a document, in order.

    A hyphen that begins a line begins speech to the end of the line, less the author's words set off by hyphens after a break mark. An open quote after a colon begins speech to
    the next close quote. An open quote after a break mark, or at the start, does so if the close quote ends the line or is followed by a hyphen; other quotes are
    quoted words. Speech that the text's end cuts off is kept. note finds the author's words after a hyphen (see after_dash).
    """
    out: list[Said] = []
    state, back, start, i = "author", "author", 0, 0

    def flush(end: int, tag: str | None) -> None:
        if end > start:
            out.append(Said(start, end, tag))

    while i < len(ts):
        t, prev = ts[i], ts[i - 1] if i else None
        if state == "dash":
            if t.hyphen and prev and prev.breaks and i > start and (to := note(ts, i, start)):
                flush(i, INSERTION if to[1] else ENDING)
                start, state, i = to[0], "dash" if to[1] else "author", to[0]
                continue
            if t.newline:
                flush(i + 1, STARTING if start >= 2 and ts[start - 2].text == ":" else ALTERNATION)
                state = "author"
        elif state == "colon":
            if t.closes:
                flush(i, STARTING)
                state = "author"
        elif state == "quote":
            after = ts[i + 1] if i + 1 < len(ts) else None
            if t.closes:
                if t.newline or (after and after.newline and not after.word and not after.hyphen):
                    flush(i, None)
                elif after and (after.hyphen or (after.breaks and i + 2 < len(ts) and ts[i + 2].hyphen)):
                    flush(i, ENDING)
                state = "author"
            elif t.hyphen and prev and prev.breaks and i > start:
                flush(i, INSERTION)
                state, back = "insertion", "quote"
        elif t.hyphen and (prev is None or prev.newline):
            state, start = "dash", i + 1
            if t.newline:
                state = "author"
        elif t.opens and prev and ":" in prev.text:
            state, start = "colon", i + 1
        elif t.opens and (prev is None or not prev.word):
            state, start = "quote", i + 1
        elif state == "insertion" and t.hyphen and prev and prev.breaks:
            state, start = back, i + 1
        i += 1
    if state in ("dash", "colon", "quote"):
        flush(len(ts), None)
    return out


SCHEMA = "doc_id string, seq int, start int, end int, replica string, tag string, line_no int"
ARROW = pa.schema([("doc_id", pa.string()), ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("replica", pa.string()), ("tag", pa.string()), ("line_no", pa.int32())])


def rows_of(key: str, text: str) -> list[dict]:
    ts = tokenize(text)
    spans = [(s, ts[s.lo].start, ts[s.hi - 1].end) for s in extract(ts)]
    return [{"doc_id": key, "seq": n, "start": a, "end": b, "replica": text[a:b], "tag": s.tag, "line_no": ts[s.lo].line} for n, (s, a, b) in enumerate(spans)]


def replicas(docs: DataFrame) -> DataFrame:
    """A row a spoken line of docs (doc_id, text). A document is one row, so nothing is shuffled; works on streams as well."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for r in rows_of(key, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)

    return docs.selectExpr("cast(doc_id AS string) AS doc_id", "text").mapInArrow(run, SCHEMA)
