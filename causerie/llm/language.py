"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.llm.common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the labelled sample: rows a language, and characters of a row to be in it.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 20_000
ROUNDS = 3
SMOOTHING = 0.1
SPACE = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: Letters of new words that are summed at a time.
LETTERS = 400_000
CODES = 0x110000
REMEMBERED = 200_000


def vocabulary(path: str = VOCABULARY) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


class Lattice:
    """Which pieces of the vocabulary lie where in words: a trie as sorted arrays, walked for all positions at once."""

    def __init__(self, pieces: list[str]) -> None:
        ids = {p: i for i, p in enumerate(pieces) if not re.fullmatch(r"<.+>", p)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        nodes = {"": 0}
        for p in ids:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        inner = [(nodes[p[:-1]] * CODES + ord(p[-1]), n, ids.get(p, -1)) for p, n in nodes.items() if p]
        self.keys, self.child, self.piece = np.array(sorted(inner), np.int64).T.copy()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, ...]]]:
        """(word, start, end, id) of all pieces, and runs of ids: id -k stands for run number k - 1, the bytes of a character that is no piece."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), n)
        first = np.cumsum(n) - n
        stop = (first + n)[owner]
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found = []
        while len(at):
            key = node * CODES + codes[at + depth]
            ix = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[ix] == key
            at, ix = at[there], ix[there]
            depth += 1
            whole = self.piece[ix] >= 0
            found.append((at[whole], at[whole] + depth, self.piece[ix[whole]]))
            more = at + depth < stop[at]
            at, node = at[more], self.child[ix[more]]
        single = np.ones(len(codes), bool)
        single[found[0][0] if found else []] = False
        odd = np.flatnonzero(single)
        kinds: dict[int, int] = {}
        runs = [kinds.setdefault(c, -len(kinds) - 1) for c in codes[odd].tolist()]
        found.append((odd, odd + 1, np.array(runs, np.int64)))
        start, end, ids = (np.concatenate(x) for x in zip(*found))
        written = [tuple(self.bytes.get(b, 0) for b in chr(c).encode("utf-8", "surrogatepass")) for c in kinds]
        return owner[start], start - first[owner[start]], end - first[owner[start]], ids, written


@dataclass
class Model:
    """log_p: pieces x languages, and a last column for no language: all pieces alike."""

    languages: list[str]
    pieces: list[str]
    log_p: np.ndarray

    @cached_property
    def scorer(self) -> Scorer:
        """One a process, so that tasks that follow each other in it remember the same words."""
        return Scorer(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "scorer"}


class Forward:
    """Logs of sums over all segmentations of many words at once.

    The state is one flat array with a place for each position of each word, so memory is in proportion to the letters, whatever the words' lengths.
    """

    def __init__(self, lattice: Lattice, words: list[str]) -> None:
        owner, start, end, ids, self.runs = lattice.arcs(words)
        n = np.array([len(w) for w in words], np.int64)
        self.last = np.cumsum(n + 1) - 1
        self.first = self.last - n
        order = np.argsort(end * len(words) + owner)
        self.owner, self.ids = owner[order], ids[order]
        self.start, self.end = start[order], end[order]
        self.before, self.after = self.first[self.owner] + self.start, self.first[self.owner] + self.end

    def arc_p(self, log_p: np.ndarray) -> np.ndarray:
        """Logs of the arcs' probabilities, by language; a character that is no piece has the product of its bytes."""
        out = log_p[np.maximum(self.ids, 0)]
        if self.runs:
            odd = self.ids < 0
            out[odd] = np.array([log_p[list(run)].sum(0) for run in self.runs])[-self.ids[odd] - 1]
        return out

    @staticmethod
    def _walk(a: np.ndarray, p: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray) -> None:
        """a[target] = log of the sum of exp(a[source] + p) over the arcs into each target; arcs are sorted by step, then target, and lead to later steps only."""
        firsts = np.flatnonzero(np.diff(target, prepend=-1))
        cuts = np.flatnonzero(np.diff(step[firsts], prepend=step[firsts][:1] - 1)) if len(firsts) else firsts
        firsts = np.append(firsts, len(target))
        for i, j in zip(cuts, [*cuts[1:], len(firsts) - 1]):
            lo, hi = firsts[i], firsts[j]
            terms = a[source[lo:hi]] + p[lo:hi]
            at = firsts[i:j] - lo
            top = np.maximum.reduceat(terms, at)
            terms -= np.repeat(top, np.diff(firsts[i : j + 1]), axis=0)
            a[target[firsts[i:j]]] = top + np.log(np.add.reduceat(np.exp(terms, out=terms), at))

    def alphas(self, p: np.ndarray) -> np.ndarray:
        a = np.zeros((int(self.last[-1]) + 1 if len(self.last) else 0, p.shape[1]))
        self._walk(a, p, self.before, self.after, self.end)
        return a

    def totals(self, p: np.ndarray) -> np.ndarray:
        return self.alphas(p)[self.last]

    def expected(self, p: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece in one language (p of one column)."""
        a, b = self.alphas(p), np.zeros((int(self.last[-1]) + 1 if len(self.last) else 0, 1))
        order = np.argsort(self.owner - self.start * len(self.first))
        self._walk(b, p[order], self.after[order], self.before[order], -self.start[order])
        uses = np.exp((a[self.before] + p + b[self.after] - a[self.last[self.owner]])[:, 0]) * counts[self.owner]
        out = np.bincount(np.maximum(self.ids, 0), np.where(self.ids >= 0, uses, 0), size)
        for run, n in zip(self.runs, np.bincount(np.maximum(-self.ids - 1, 0), np.where(self.ids < 0, uses, 0), len(self.runs))):
            for i in run:
                out[i] += n
        return out


class Scorer:
    """Log of the sum over all segmentations of each word, by language, remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        self.lattice, self.log_p = Lattice(model.pieces), model.log_p
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, model.log_p.shape[1]))

    def words(self, new: list[str]) -> np.ndarray:
        """By so many letters at a time, words of like length together."""
        out = np.empty((len(new), self.log_p.shape[1]))
        order = sorted(range(len(new)), key=lambda k: len(new[k]))
        ends = np.cumsum([len(new[k]) + 1 for k in order])
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LETTERS, "right")))
            f = Forward(self.lattice, [SPACE + new[k] for k in order[lo:hi]])
            out[order[lo:hi]] = f.totals(f.arc_p(self.log_p))
            lo = hi
        return out

    def score(self, docs: list[list[str]]) -> np.ndarray:
        """Log-likelihoods: documents x (languages and none)."""
        flat = [w for d in docs for w in d]
        new = set(flat).difference(self.at)
        if self.at and len(self.at) + len(new) > REMEMBERED:
            self.at.clear()
            self.rows = self.rows[:0]
            new = set(flat)
        if new:
            fresh = list(new)
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
            self.rows = np.concatenate([self.rows, self.words(fresh)])
        ix = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        total = np.zeros((len(docs), self.rows.shape[1]))
        some = np.flatnonzero(np.diff(firsts))
        if len(some):
            total[some] = np.add.reduceat(self.rows[ix], firsts[some])
        return total


def fit(samples: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities of each language by expectation-maximisation over all segmentations of its texts' words."""
    lattice, languages = Lattice(pieces), sorted(samples)
    log_p = np.full((len(pieces), len(languages) + 1), -math.log(len(pieces)))
    for k, lang in enumerate(languages):
        counts = Counter(w for t in samples[lang] for w in WORD.findall(t.lower()))
        f, n = Forward(lattice, [SPACE + w for w in counts]), np.array(list(counts.values()), float)
        for _ in range(rounds):
            uses = f.expected(f.arc_p(log_p[:, k : k + 1]), n, len(pieces)) + smoothing
            log_p[:, k] = np.log(uses / uses.sum())
    return Model(languages, pieces, log_p)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Texts of each label, those of the smallest hashes of id and text: at most rows a label, each of at most chars characters; of repeated rows one.

    First the hash up to which distinct rows are taken is found, for which languages and hashes alone are shuffled; then those texts are fetched.
    """
    fit_for = docs.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) <= chars)).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    first = fit_for.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows)
    cuts = [(r["lang"], r["h"]) for r in first.groupBy("lang").agg(F.max("h").alias("h")).collect()]
    out: dict[str, list[str]] = {lang: [] for lang, _ in cuts}
    if not cuts:
        return out
    wanted = F.lit(False)
    for lang, h in cuts:
        wanted = wanted | ((F.col("lang") == lang) & (F.col("h") <= h))
    for r in sorted(fit_for.where(wanted).distinct().collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(out[r["lang"]]) < rows:
            out[r["lang"]].append(r["text"])
    return out


def identify(docs: DataFrame, model: Model, min_posterior: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, posterior, log_likelihood, n_words, accepted) for every row of docs.

    Words are the runs of letters of the lower-case text. A word's likelihood in a language is the sum, over all its segmentations into pieces
    of the vocabulary, of the product of the pieces' probabilities. No piece crosses a word's bounds, so a text's is the product of its words'
    likelihoods, and each distinct word is summed once for as long as it is remembered. All sums are in logs, whatever a word's length and letters: none is
    below the least float, so likelihoods are finite. language is the most likely one (posterior: languages equally likely before); on equal
    likelihood the first by name.

    accepted: some language makes the text more likely than no language does, which has all pieces of the vocabulary alike, and its
    posterior among all of these is at least min_posterior. Texts without a word, null among them, have language null, posterior 0 and are not accepted. Ids may repeat or be null; repeated rows have a row each. An empty table gives no rows, and a model without languages
    null, 0 and not accepted for all. Very long texts and words are scored whole, a word by its letters' number of steps. Other columns are not read. No shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), *verdicts(shared.value, part.column("text").to_pylist(), min_posterior)], ["id", "language", "posterior", "log_likelihood", "n_words", "accepted"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(label, f"id {kind}, language string, posterior double, log_likelihood double, n_words bigint, accepted boolean").withColumnRenamed("id", id_col)


def verdicts(model: Model, texts: list[str | None], min_posterior: float) -> list[pa.Array]:
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    if not model.languages:
        return [pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n))), pa.nulls(len(n), pa.float64()), pa.array(n), pa.array(np.zeros(len(n), bool))]
    total = model.scorer.score(words)
    at, k = np.arange(len(n)), len(model.languages)
    best = total[:, :k].argmax(1)
    posterior = np.where(n > 0, 1 / np.exp(np.minimum(total - total[at, best][:, None], 700)).sum(1), 0)
    accepted = (n > 0) & (posterior >= min_posterior) & (total[at, best] > total[:, k])
    names = pa.array([model.languages[k] if some else None for k, some in zip(best, n > 0)], pa.string())
    return [names, pa.array(posterior), pa.array(total[at, best], mask=n == 0), pa.array(n), pa.array(accepted)]


def keep_known(docs: DataFrame, vocabulary_path: str = VOCABULARY, min_posterior: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns; the model is fitted on docs' own labels. See identify.

    Null, empty and blank texts have no language and go, as does everything if no row has a label. Repeated rows stay or go together; null ids are ids like others; an
    empty table gives no rows. Columns are addressed by name, so others of any name pass through. The test is a filter on the text inside the scan's own stage; nothing is shuffled or joined.
    """
    model = fit(sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), vocabulary(vocabulary_path))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [verdicts(shared.value, texts.slice(lo, 500).to_pylist(), min_posterior)[-1] for lo in range(0, len(texts), 500)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(known(F.col(text_col)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(sample(docs), vocabulary()))


SQL: dict[str, str] = {}
QUERIES = {"op10_language_id": op10_language_id}
