"""Plays laid out from turns: a label line and a line of speech each, with spans by running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causerie.functions.text import collapse
from causerie.operators.sequences import offsets
from causerie.schema import CHARACTER, MENTION, REPLICA


def layout(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, chunk, start, end, speaker) of turns (conv_id, turn, role, text). kind 0: the speaker's label, a mention; kind 1: what is said.

    White space in a text is collapsed; an empty text has no line. One shuffle by conv_id.
    """
    said = turns.select("conv_id", "turn", "role", collapse(F.col("text")).alias("said"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("role").alias("chunk")), F.struct(F.lit(1).alias("kind"), F.col("said").alias("chunk")))
    chunks = said.select("conv_id", "turn", "role", F.explode(both).alias("c")).select("conv_id", "turn", "role", "c.kind", "c.chunk").where("chunk <> ''")
    placed = offsets(chunks, "conv_id", ["turn", "kind"], F.char_length("chunk"))
    return placed.select("conv_id", "turn", "kind", "chunk", "start", (F.col("start") + F.char_length("chunk")).alias("end"), F.col("role").alias("speaker"))


def to_docs(turns: DataFrame) -> DataFrame:
    """The plays as interchange documents: characters are the roles, in alphabetical order."""
    rows = layout(turns)
    chunk = F.struct("turn", "kind", "chunk", "start", "end", "speaker")
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(chunk)).alias("c"), F.sort_array(F.collect_set("speaker")).alias("who"))
    rep = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["speaker"].alias("speaker"), F.lit(None).cast("string").alias("addressee"), F.lit(None).cast("string").alias("qtype"), F.lit(None).cast("struct<start:int,end:int>").alias("cue"), F.lit(None).cast("string").alias("mode"))
    return each.select(
        F.concat(F.lit("play/"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.lit("en").alias("lang"),
        F.lit("drama").alias("domain"),
        F.lit("conversations").alias("source"),
        F.lit("synthetic").alias("license"),
        F.concat(F.array_join(F.transform("c", lambda x: x["chunk"]), "\n"), F.lit("\n")).alias("text"),
        F.transform(F.filter("c", lambda x: x["kind"] == 1), rep).cast(f"array<{REPLICA}>").alias("replicas"),
        F.transform("who", lambda w: F.struct(w.alias("id"), w.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("gender"))).cast(f"array<{CHARACTER}>").alias("characters"),
        F.transform(F.filter("c", lambda x: x["kind"] == 0), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["speaker"].alias("char"))).cast(f"array<{MENTION}>").alias("mentions"),
    )


def prose(turns: DataFrame, mark: str = "dash") -> DataFrame:
    """(doc_id, text): turns written as lines of prose, with a dash before or in quotes after a colon."""
    said = collapse(F.col("text"))
    line = F.concat(F.lit("– "), said) if mark == "dash" else F.concat(F.col("role"), F.lit(": «"), said, F.lit("»"))
    each = turns.where(said != "").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return each.select(F.col("conv_id").cast("string").alias("doc_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
