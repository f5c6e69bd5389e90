"""Ordered operators: neighbours, running state, gaps and offsets within a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causerie.functions.text import find
from causerie.shipping import ship


def triples(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, before, value, after): null at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, F.lag(value).over(w).alias("before"), value, F.lead(value).over(w).alias("after"))


def penult(df: DataFrame, key: str, order: str, actor: str) -> DataFrame:
    """(key, order, actor, penult): the latest earlier actor other than the one just before; null if that one is null.

    Where the speaker changes, the one before is noted; the note holds for the rest of the run, so window functions of one sort do it.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(actor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = df.select(key, order, actor, F.when(F.col(actor).isNotNull() & (before != F.col(actor)), before).alias("_note"))
    noted = changed.withColumn("_other", F.when(F.col(actor).isNotNull(), F.last("_note", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return noted.select(key, order, actor, F.lag("_other").over(w).alias("penult"))


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str = "carried") -> DataFrame:
    """The latest non-null value of the rows up to this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def offsets(df: DataFrame, key: str, order: list, size: Column, start: str = "start") -> DataFrame:
    """start: where a chunk begins if each is followed by one newline."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(size + 1).over(w), F.lit(0)).cast("bigint"))


def gaps(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, gap_start, gap_end): the stretches between spans that follow each other."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.select(key, reached.alias("gap_start"), F.col(start).alias("gap_end")).where("gap_start < gap_end")


def overlaps(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that begin before an earlier one ends."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.coalesce(F.max(end).over(w), F.lit(-1))).where(F.col(start) < F.col("reached"))


def numbered_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, start, line, above): lines from 1 with their offsets, and the nearest line before each that isn't blank.

    In Arrow batches, a document at a time: time is in proportion to the text, and nothing is shuffled.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                if t is None:
                    continue
                found, above, last = t.split("\n"), [], None
                for x in found:
                    above.append(last)
                    if x.strip():
                        last = x
                sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
                keys = b.column("key").take(pa.array([i] * len(found), pa.int64()))
                cols = [keys, pa.array(np.arange(1, len(found) + 1, dtype=np.int32)), pa.array((np.cumsum(sizes) - sizes).astype(np.int32)), pa.array(found, pa.string()), pa.array(above, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "line_no", "start", "line", "above"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"key {kind}, line_no int, start int, line string, above string").withColumnRenamed("key", key)


def line_above(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, above); see numbered_lines."""
    return numbered_lines(docs, key, text).select(key, "line_no", "line", "above")


def first_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def dedupe_ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o"))
    return first.select(*keys, "_o.*")


def zip_positional(a: DataFrame, b: DataFrame, key: str, order: str, left: str, right: str) -> DataFrame:
    """(key, n, left, right): n-th with n-th, as far as the shorter one goes."""
    w = Window.partitionBy(key).orderBy(order)
    x = a.select(key, F.row_number().over(w).alias("n"), F.col(left).alias("left"))
    y = b.select(key, F.row_number().over(w).alias("n"), F.col(right).alias("right"))
    return x.join(y, [key, "n"])


def palette(df: DataFrame, name: str, order: str, extra: DataFrame | None = None, most: int = 15) -> DataFrame:
    """(name, n): the most frequent names, first seen first on equal counts; names of extra count 0 and come after."""
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    if extra is not None:
        more = extra.groupBy(F.col(name).alias("name")).agg(F.lit(0).cast("bigint").alias("n"), F.min(order).alias("first"))
        counted = counted.unionByName(more.join(counted, "name", "left_anti"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("name", "n")


def locate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): first offset of each text b of items (item_id, b) in each text t of docs (doc_id, t), both with single spaces.

    A word inside an item, between two others, is a whole word wherever the item is found. The longest one is the key of an equality join with the
    documents' distinct words, so only documents that hold it are searched. Items of one or two words have no such word: they are put into automata of a bounded size, and
    each document is read once for each automaton, which finds all of its items together. Empty items are nowhere.
    """
    split = items.withColumn("_w", F.split("b", " "))
    inner = F.transform(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    keyed = split.withColumn("_key", F.array_max(inner)["w"]).drop("_w")
    words = docs.select("doc_id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("_key"))
    at = find(F.col("t"), F.col("b"), F.lit(0), F.char_length("t")).cast("int").alias("at")
    long = words.join(keyed.where("_key IS NOT NULL"), "_key").select("doc_id", "item_id", at)
    parts = [long, *(_by_automaton(docs, few) for few in _groups(keyed.where("_key IS NULL AND b <> ''").select("item_id", "b")))]
    return reduce(DataFrame.unionByName, parts).where("at IS NOT NULL")


#: Characters of the items that are searched for together.
AUTOMATON_CHARS = 4 << 20


def _groups(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in lists of about AUTOMATON_CHARS characters each, one at a time on the driver."""
    few, size = [], 0
    for r in items.toLocalIterator():
        few.append((r["item_id"], r["b"]))
        size += len(r["b"])
        if size >= AUTOMATON_CHARS:
            yield few
            few, size = [], 0
    if few:
        yield few


def _finder(few: list[tuple]) -> Callable[[str], dict[int, int]]:
    """Positions in few of the items found in a text, with their first offsets."""
    at: dict[str, list[int]] = {}
    for n, (_, said) in enumerate(few):
        at.setdefault(said, []).append(n)
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {n: i for said, ns in at.items() if (i := text.find(said)) >= 0 for n in ns}
    tree = ahocorasick.Automaton()
    for said in at:
        tree.add_word(said, said)
    tree.make_automaton()

    def find_all(text: str) -> dict[int, int]:
        first: dict[str, int] = {}
        for end, said in tree.iter(text):
            first.setdefault(said, end - len(said) + 1)
        return {n: i for said, i in first.items() for n in at[said]}

    return find_all


def _by_automaton(docs: DataFrame, few: list[tuple]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _finder(shared.value)
        for b in batches:
            rows, number, place = [], [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                for n, i in search(text).items() if text else ():
                    rows.append(k)
                    number.append(n)
                    place.append(i)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([shared.value[n][0] for n in number], kinds["item_id"]), pa.array(place, pa.int32())], ["doc_id", "item_id", "at"])

    ids = pa.array([i for i, _ in few])
    kinds = {"item_id": ids.type}
    item = "bigint" if pa.types.is_integer(ids.type) else "string"
    return docs.select("doc_id", "t").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item}, at int")
