"""What the engine can do for a language, with or without an annotator."""

from __future__ import annotations

import importlib.util
import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causerie.operators import annotated, attribution, replicas
from causerie.operators.spans import sentences
from causerie.operators.syntax import TOKENS
from causerie.shipping import ship

SIZES = ("sm", "md", "lg")
MODEL_VARIABLE = "CAUSERIE_RU_MODEL"


@dataclass(frozen=True)
class Pipeline:
    """Spoken lines and speakers of documents (doc_id, text), by spelling, or by an annotator's tokens where they are given."""

    language: str

    def replicas(self, docs: DataFrame) -> DataFrame:
        return replicas.replicas(docs)

    def play(self, docs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
        return attribution.lines(docs) if tokens is None else annotated.lines(tokens)


def load(code: str) -> Pipeline | None:
    """The pipeline of a language, or None if there is none."""
    return Pipeline("ru") if code.strip().lower() == "ru" else None


def model_name(size: str | None = None, installed=importlib.util.find_spec) -> str:
    """The annotator's model: of the size asked for, or named in the environment, or the large one; the small one, with a warning, where that isn't installed."""
    size = size or os.environ.get(MODEL_VARIABLE) or "lg"
    if size not in SIZES:
        raise ValueError(f"size must be one of {SIZES}")
    name = f"ru_core_news_{size}"
    if installed(name) is None:
        if size == "sm" or installed("ru_core_news_sm") is None:
            raise ModuleNotFoundError(f"{name} is not installed")
        warnings.warn(f"{name} is not installed; the small model is taken", stacklevel=2)
        name = "ru_core_news_sm"
    return name


def annotate(docs: DataFrame, size: str | None = None) -> DataFrame:
    """Tokens (syntax.TOKENS) of docs by spaCy, where it and a Russian model are installed: one model a task, texts in Arrow batches.

    Line breaks become spaces for the annotator; a token is the last of its line if a break follows it.
    """
    name = model_name(size)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import spacy

        model = spacy.load(name, exclude=["senter"])
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for key, text, doc in zip(b.column("doc_id").to_pylist(), texts, model.pipe(t.replace("\n", " ") for t in texts)):
                kept = [t for t in doc if not t.is_space]
                at = {t.i: k for k, t in enumerate(kept)}
                for k, t in enumerate(kept):
                    end = t.idx + len(t)
                    after = kept[k + 1].idx if k + 1 < len(kept) else len(text)
                    morph = list({f: v.split(",")[0] for f, v in t.morph.to_dict().items()}.items())
                    rows.append({"doc_id": key, "i": k, "start": t.idx, "end": end, "text": t.text, "newline": k + 1 == len(kept) or "\n" in text[end:after], "lemma": t.lemma_, "pos": t.pos_, "dep": t.dep_, "head": at.get(t.head.i, k), "morph": morph, "ent": t.ent_type_ or None})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def corrected(tokens: DataFrame, forced: dict[str, str]) -> DataFrame:
    """Tokens with another part of speech for some surface forms that the annotator misreads."""
    pos = F.col("pos")
    for form, kind in forced.items():
        pos = F.when(F.lower(F.trim("text")) == form, F.lit(kind)).otherwise(pos)
    return tokens.withColumn("pos", pos)


_ARROW = pa.schema([("doc_id", pa.string()), ("i", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("newline", pa.bool_()), ("lemma", pa.string()), ("pos", pa.string()), ("dep", pa.string()), ("head", pa.int32()), ("morph", pa.map_(pa.string(), pa.string())), ("ent", pa.string())])


#: Surface forms that the annotator takes for nouns.
MISREAD = {"шепчет": "VERB"}


def annotated_tokens(docs: DataFrame, size: str | None = None, annotator: Callable[[DataFrame], DataFrame] | None = None, forced: dict[str, str] | None = None) -> DataFrame:
    """Tokens of docs by the whole chain: the annotator (spaCy by default), lines, sentences, then corrections. Columns line_no and sentence come in addition."""
    found = annotator(docs) if annotator else annotate(docs, size)
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lined = found.withColumn("line_no", (1 + F.coalesce(F.sum(F.col("newline").cast("int")).over(w), F.lit(0))).cast("int"))
    return corrected(sentences(lined), MISREAD if forced is None else forced)
