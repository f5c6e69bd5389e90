"""Spans of a document against each other, its lines and its tokens, by window functions: no join of spans with spans."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(spans: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """spans with a column inside: is it within one of outer's spans of the same key? Its complement drops what lies in others.

    Of the outer spans that begin no later, the one that reaches furthest decides, so one sort by (key, start) does it. Null bounds are inside nothing.
    """
    tagged = spans.withColumns({"_outer": F.lit(False), "_reach": F.lit(None).cast("bigint")})
    others = outer.select(key, F.col(start).alias(start), F.lit(True).alias("_outer"), F.col(end).cast("bigint").alias("_reach"))
    both = tagged.unionByName(others, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_first(), F.col("_outer").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.coalesce(F.max("_reach").over(w) >= F.col(end), F.lit(False)) & F.col(start).isNotNull())
    return found.where("NOT _outer").drop("_outer", "_reach")


def line_span(spans: DataFrame, lines: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """spans with start_line and end_line: the lines of (key, line_no, start) in which their first and last characters are."""

    def located(df: DataFrame, at: Column, out: str) -> DataFrame:
        tagged = df.withColumns({"_at": at.cast("bigint"), "_no": F.lit(None).cast("int"), "_line": F.lit(False)})
        places = lines.select(key, F.col("start").cast("bigint").alias("_at"), F.col("line_no").cast("int").alias("_no"), F.lit(True).alias("_line"))
        w = Window.partitionBy(key).orderBy("_at", F.col("_line").desc()).rowsBetween(Window.unboundedPreceding, 0)
        both = tagged.unionByName(places, allowMissingColumns=True).withColumn(out, F.last("_no", ignorenulls=True).over(w))
        return both.where("NOT _line").drop("_at", "_no", "_line")

    return located(located(spans, F.col(start), "start_line"), F.col(end) - 1, "end_line")


def near(tokens: DataFrame, holds: Column, radius: int, key: str = "doc_id", order: str = "i") -> DataFrame:
    """tokens with near: does a condition hold for one of the radius tokens before, the token, or the radius - 1 after it?"""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-radius, radius - 1)
    return tokens.withColumn("near", F.coalesce(F.max(holds).over(w), F.lit(False)))


def breaks_between(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Line breaks between two spans, each given by the lines of its begin and end: from the end of the earlier one to the begin of the later."""
    return F.when(second[0] >= first[1], second[0] - first[1]).otherwise(first[0] - second[1])


def sentences(tokens: DataFrame) -> DataFrame:
    """Annotated tokens with the number of their sentence, from 1.

    A sentence begins after a line's last token, or at it if that is a hyphen, and at the first token after an end mark that is no punctuation, or is a hyphen; see Sentences.sentences.
    """
    from causerie.operators.syntax import STOPS
    from causerie.operators.tokens import HYPHENS

    word = F.col("text").rlike(r"[\p{L}\p{N}]")
    stop = F.col("text").isin(*STOPS) | (F.left("text", F.lit(1)).isin("?", "!") & ~word)
    hyphen = F.col("text").isin(*HYPHENS)
    opens = ~F.col("newline") & ~stop & (hyphen | ~((F.col("pos") == "PUNCT") | ~word))
    w = Window.partitionBy("doc_id").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = tokens.withColumns({"_stop": F.when(stop & ~F.col("newline"), F.col("i")), "_reset": F.when(F.col("newline") | opens, F.col("i")), "_opens": opens, "_after": F.col("newline") & ~hyphen, "_at": F.col("newline") & hyphen})
    ended = F.coalesce(F.max("_stop").over(before), F.lit(-1)) > F.coalesce(F.max("_reset").over(before), F.lit(-1))
    begins = (F.col("_opens") & ended) | F.col("_at") | F.coalesce(F.lag("_after").over(w), F.lit(True))
    flagged = marked.withColumn("_begins", begins.cast("int"))
    return flagged.withColumn("sentence", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_stop", "_reset", "_opens", "_after", "_at", "_begins")


class Spelt(dict):
    """Of each spelling, worked out once: is it an end mark (1), a hyphen (2), a word or number (4)?"""

    MOST = 200_000

    def __missing__(self, text: str) -> int:
        from causerie.operators.syntax import STOPS
        from causerie.operators.tokens import HYPHENS

        word = any(unicodedata.category(c)[0] in "LN" for c in text)
        if len(self) >= self.MOST:
            self.clear()
        self[text] = bits = (text in STOPS or (text[0] in "?!" and not word)) + 2 * (text in [*HYPHENS]) + 4 * word
        return bits


class SpeltSentences:
    """The numbers that sentences gives, for tokens.tokens to derive: of tokens that are PUNCT if they have neither letters nor digits."""

    kind = "int"

    def __init__(self) -> None:
        self.spelt = Spelt()

    def __call__(self, columns: dict) -> np.ndarray:
        from causerie.operators.tokens import last_before

        said, newline = columns["text"], columns["newline"]
        bits = np.fromiter(map(self.spelt.__getitem__, said), np.int64, len(said))
        stop, hyphen = (bits & 1).astype(bool), (bits & 2).astype(bool)
        opens = ~newline & ~stop & (bits & 6).astype(bool)
        ended = last_before(stop & ~newline) > last_before(newline | opens)
        after = np.concatenate([[True], (newline & ~hyphen)[:-1]])[: len(said)]
        return np.cumsum((opens & ended) | (newline & hyphen) | after)


class SpeltNear:
    """What near gives for one spelling, for tokens.tokens to derive."""

    kind = "boolean"

    def __init__(self, text: str, radius: int) -> None:
        self.text, self.radius = text, radius

    def __call__(self, columns: dict) -> np.ndarray:
        n = len(columns["text"])
        total = np.concatenate([[0], np.cumsum(np.fromiter((t == self.text for t in columns["text"]), np.int64, n))])
        at = np.arange(n)
        return total[np.minimum(at + self.radius, n)] > total[np.maximum(at - self.radius, 0)]


def prefilled(lines: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, seq, replica, actor) with the speaker that gold (key, replica, actor) gives the same words, where it does; of several the last by seq, if gold has one."""
    order = F.col("seq") if "seq" in gold.columns else F.lit(0)
    told = gold.groupBy(key, "replica").agg(F.max_by("actor", order).alias("_gold"))
    return lines.join(told, [key, "replica"], "left").withColumn("actor", F.coalesce("_gold", "actor")).drop("_gold")
