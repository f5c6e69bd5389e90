"""Tokens of a text by spelling alone, and what can be asked of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causerie.shipping import pieces, ship

HYPHENS = "-–—−"
OPEN_QUOTES = frozenset("«\"“„‘‚‹'「『＂")
CLOSE_QUOTES = frozenset("»\"”“’‘›'」』＂")
ENDS = frozenset("…?!.") | {"..."}
BREAKS = ENDS | {",", ";", ":"}
TOKEN = re.compile(r"\.\.\.|[?!]+…?|\w+(?:[-’']\w+)*|[^\w\s]")


@dataclass(slots=True)
class Token:
    i: int
    start: int
    end: int
    text: str
    newline: bool  # the last of its line, or of the text
    line: int = 1
    sentence: int = 0

    @property
    def hyphen(self) -> bool:
        return self.text in HYPHENS

    @property
    def word(self) -> bool:
        return self.text[0].isalnum()

    @property
    def title(self) -> bool:
        return self.text.istitle()

    @property
    def opens(self) -> bool:
        return self.text in OPEN_QUOTES

    @property
    def closes(self) -> bool:
        return self.text in CLOSE_QUOTES

    @property
    def ends(self) -> bool:
        return self.text in ENDS or (self.text[0] in "?!")

    @property
    def breaks(self) -> bool:
        return self.text in BREAKS or self.ends


def tokenize(text: str) -> list[Token]:
    """Lines count from 1. A sentence ends with its line, and after an end mark when a word or a hyphen follows."""
    out: list[Token] = []
    found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    line = sentence = 1
    for i, (start, end, s) in enumerate(found):
        after = found[i + 1][0] if i + 1 < len(found) else len(text)
        newline = i + 1 == len(found) or "\n" in text[end:after]
        t = Token(i, start, end, s, newline, line)
        if out and (out[-1].newline or (_ended(out) and (t.word or t.hyphen or t.opens))):
            sentence += 1
        t.sentence = sentence
        out.append(t)
        if newline:
            line += text.count("\n", end, after)
    return out


def _ended(before: list[Token]) -> bool:
    k = len(before) - 1
    while k >= 0 and not before[k].word and not before[k].hyphen:
        if before[k].ends:
            return True
        k -= 1
    return False


SCHEMA = "doc_id string, i int, start int, end int, text string, line_no int, sentence int, newline boolean, is_word boolean, is_title boolean, is_hyphen boolean, opens boolean, closes boolean"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
KINDS = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
ARROW = pa.schema([(n, _KINDS[k]) for n, k in KINDS.items()])
PLACED = frozenset("start end line_no sentence newline".split())
FLAGS = ("is_word", "is_title", "is_hyphen", "opens", "closes", "ends")


class Flags(dict):
    """What the spelling of a token tells, as bits in the order of FLAGS, worked out once a spelling."""

    MOST = 200_000

    def __missing__(self, text: str) -> int:
        t = Token(0, 0, 0, text, False)
        bits = sum(1 << k for k, holds in enumerate((t.word, t.title, t.hyphen, t.opens, t.closes, t.ends)) if holds)
        if len(self) >= self.MOST:
            self.clear()
        self[text] = bits
        return bits


def last_before(mark: np.ndarray) -> np.ndarray:
    """Position of the last marked one before each, or -1."""
    at = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    return np.concatenate([[-1], at[:-1]])


def columns_of(text: str, wanted: Sequence[str], flags: Flags) -> dict[str, list | np.ndarray]:
    """The wanted columns of a text's tokens, as arrays; those of tokenize."""
    out: dict[str, list | np.ndarray] = {}
    if PLACED.isdisjoint(wanted):
        said = TOKEN.findall(text)
    else:
        spans = np.fromiter((x for m in TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
        out["start"], out["end"] = spans[:, 0], spans[:, 1]
        said = [text[a:b] for a, b in spans.tolist()]
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
        line = np.searchsorted(breaks, spans[:, 0])
        out["line_no"] = line - line[:1] + 1
        out["newline"] = np.append(np.diff(line) > 0, True)[: len(said)]
    out["text"], out["i"] = said, np.arange(len(said))
    if not {*FLAGS, "sentence"}.isdisjoint(wanted):
        bits = np.fromiter(map(flags.__getitem__, said), np.int64, len(said))
        out |= {name: (bits >> k & 1).astype(bool) for k, name in enumerate(FLAGS)}
    if "sentence" in wanted:
        stays = out["is_word"] | out["is_hyphen"]
        ended = last_before(out["ends"] & ~stays) > last_before(stays)
        begins = np.concatenate([[False], out["newline"][:-1]])[: len(said)] | (ended & (stays | out["opens"]))
        out["sentence"] = 1 + np.cumsum(begins)
    return {name: out[name] for name in wanted}


def tokens(docs: DataFrame, *columns: str, **derived: Callable[[dict], np.ndarray]) -> DataFrame:
    """A row a token of docs (doc_id, text): doc_id and columns, or all of SCHEMA; null and empty texts have none.

    Columns are made as arrays, a batch of documents at a time; naming those needed saves the work for the others (offsets and lines cost the most).
    derived: more columns, of the type that a function has as its kind, each made of the arrays text and newline of a document; documents are whole in their rows, so nothing is shuffled for them.
    """
    ship(docs.sparkSession)
    wanted = [c for c in columns if c != "doc_id"] or [c for c in KINDS if c != "doc_id" and not derived]
    made = list(dict.fromkeys([*wanted, *(("text", "newline") if derived else ())]))
    kinds = KINDS | {name: f.kind for name, f in derived.items()}
    schema = pa.schema([pa.field(c, _KINDS[kinds[c]]) for c in ("doc_id", *wanted, *derived)])
    shown = schema.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags()
        for b in (p for whole in batches for p in pieces(whole)):
            keys, texts = b.column("doc_id"), b.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                owner, parts, n = [], [], 0
                while lo < len(texts) and n < 200_000:
                    if texts[lo]:
                        part = columns_of(texts[lo], made, flags)
                        part |= {name: f(part) for name, f in derived.items()}
                        parts.append({c: part[c] for c in shown})
                        size = len(parts[-1][shown[0]])
                        owner.append(np.full(size, lo))
                        n += size
                    lo += 1
                if n:
                    cols = [keys.take(pa.array(np.concatenate(owner)))]
                    for c in shown:
                        cols.append(pa.array([x for p in parts for x in p[c]], pa.string()) if c == "text" else pa.array(np.concatenate([p[c] for p in parts])).cast(schema.field(c).type))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.selectExpr("cast(doc_id AS string) AS doc_id", "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in schema.names))


def has_newline(ts: list[Token], i: int) -> bool:
    return ts[i].newline


def line_start(ts: list[Token], i: int) -> int:
    """First position of the line that holds i."""
    while i > 0 and not ts[i - 1].newline:
        i -= 1
    return i


def line_end(ts: list[Token], i: int) -> int:
    """Last position of the line that holds i."""
    while not ts[i].newline:
        i += 1
    return i


def near(ts: list[Token], i: int, radius: int, text: str) -> bool:
    """Is text among the radius tokens before i or the radius - 1 after it?"""
    return any(t.text == text for t in ts[max(0, i - radius) : i + radius])


def trim(ts: list[Token], lo: int, hi: int) -> tuple[int, int]:
    """[lo, hi) without tokens at its ends that aren't words."""
    while lo < hi and not ts[lo].word:
        lo += 1
    while hi > lo and not ts[hi - 1].word:
        hi -= 1
    return lo, hi


def contiguous(ts: list[Token], end: int, start: int) -> bool:
    """No word between two spans."""
    return not any(t.word for t in ts[end:start])


def parenthesized(ts: list[Token], lo: int, hi: int) -> bool:
    return lo < hi and near(ts, lo, 3, "(") and near(ts, hi - 1, 3, ")")


def fills_line(ts: list[Token], lo: int, hi: int) -> bool:
    """Does a line end within three tokens before a span, without a colon among them, and at its last token or within three after it?"""
    before = ts[max(0, lo - 3) : lo]
    colon = ":" in {t.text for t in before}
    return not colon and any(t.newline for t in before) and any(t.newline for t in ts[hi - 1 : hi + 3])


def line_breaks(ts: list[Token], a: tuple[int, int], b: tuple[int, int]) -> int:
    first, second = sorted((a, b))
    return ts[second[0]].line - ts[first[1] - 1].line
