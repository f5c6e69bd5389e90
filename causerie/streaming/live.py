"""The same operators on streams: whole texts as they arrive, and turns of conversations under way."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causerie.operators import attribution
from causerie.schema import DOC
from causerie.shipping import shared_dir, ship

TURNS = "doc_id string, seq int, text string, speaker string, at timestamp"
OUT = "doc_id string, seq int, text string, actor string, rule string"
STATE = "next int, last string, penult string, waiting array<struct<seq:int,text:string,speaker:string>>"


def read_documents(spark: SparkSession, path: str, files_a_time: int = 100) -> DataFrame:
    """Interchange documents of lines of JSON, as files come."""
    return spark.readStream.schema(DOC).option("maxFilesPerTrigger", files_a_time).json(path)


def lines(docs: DataFrame) -> DataFrame:
    """Spoken lines and speakers of streamed documents; needs no state, a document being one row."""
    return attribution.lines(docs.select("doc_id", "text"))


def follow(key: tuple[str], turns: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Speakers of the turns that are next in order; turns that came early wait in the state."""
    if state.hasTimedOut:
        at, last, penult, waiting = state.get
        state.remove()
        rows = after_gap(key[0], sorted(((w["seq"], w["text"], w["speaker"]) for w in map(_fields, waiting or [])), key=lambda w: w[0]))
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "actor", "rule"])
        return
    at, last, penult, waiting = state.get if state.exists else (0, None, None, [])
    queue: dict[int, tuple[str, str | None]] = {w["seq"]: (w["text"], w["speaker"]) for w in map(_fields, waiting or [])}
    for df in turns:
        for seq, text, speaker in zip(df["seq"], df["text"], df["speaker"]):
            if int(seq) >= at:
                queue.setdefault(int(seq), (text, speaker if isinstance(speaker, str) else None))
    rows = []
    while at in queue:
        text, speaker = queue.pop(at)
        if speaker is not None:
            actor, rule = speaker, "given"
        elif penult is not None:
            actor, rule = penult, "alternation"
        else:
            actor, rule = last, "last" if last is not None else "none"
        rows.append((key[0], at, text, actor, rule))
        if actor is not None and actor != last:
            last, penult = actor, last
        at += 1
    state.update((at, last, penult, [{"seq": k, "text": t, "speaker": s} for k, (t, s) in sorted(queue.items())]))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 3_600_000)
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "actor", "rule"])


def after_gap(doc_id: str, waiting: list[tuple[int, str, str | None]]) -> list[tuple]:
    """Rows of the turns that waited for a missing one, in order. Who spoke before a gap says nothing about who speaks after it."""
    rows, last, penult, before = [], None, None, None
    for seq, text, speaker in waiting:
        if before is None or seq != before + 1:
            last = penult = None
        actor = speaker if speaker is not None else penult if penult is not None else last
        rows.append((doc_id, seq, text, actor, "after_gap"))
        if actor is not None and actor != last:
            last, penult = actor, last
        before = seq
    return rows


def _fields(w: Any) -> dict:
    return w if isinstance(w, dict) else w.asDict()


def live_lines(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Turns (TURNS) with speakers: the one given, else the speaker before the last one, else the last one.

    A document's turns are numbered from 0 and may come in any order within the watermark; those that come again are dropped. A document without turns for an hour is forgotten;
    turns that still wait for a missing one are given out then, in order and with the rule after_gap, speakers found from the turns since the gap alone.
    Turns that come later count from 0 again, so they wait and are given out in the same way.
    """
    ship(turns.sparkSession)
    marked = turns.withWatermark("at", late)
    return marked.groupBy("doc_id").applyInPandasWithState(follow, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None):
    """A query that writes each row once; its progress is kept in the shared folder."""
    spark = df.sparkSession
    writer = df.writeStream.format(sink).outputMode("append").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}")
    return (writer.option("path", path) if path else writer).trigger(availableNow=True).start()
