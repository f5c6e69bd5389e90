"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.llm.common import n_tokens, table, written

CAPACITY = 2048
#: Pieces are ranked within slices of the hash of about this many.
SLICE_PIECES = 25_000


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """Numbers of pieces of each length with the largest total up to capacity.

    lengths: those with a count, longest first. Bit s of an integer says whether some choice adds up to s; a length of count c is shifted in
    1, 2, 4, ... pieces at a time. A choice that fills the capacity ends the search: nothing is fuller.
    """
    reach, steps, full = 1, [], 1 << capacity
    mask = (full << 1) - 1
    for length in lengths:
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            take = min(chunk, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass
class Plan:
    """Where pieces go, by length and rank among the pieces of that length: parallel arrays sorted by (length, rank).

    From rank on, each pieces of the length go to a bin, from bin first on, to the slots from slot on; total is the bins' tokens.
    """

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    slot: np.ndarray
    total: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, slot, bin's tokens) of pieces."""
        # both sorted by (length, rank): a length's own stretch, then the rank within it
        lo, hi = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        while (wide := hi - lo > 1).any():
            mid = (lo + hi) // 2
            below = wide & (self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank)
            lo, hi = np.where(below, mid, lo), np.where(wide & ~below, mid, hi)
        past = rank - self.rank[lo]
        return self.first[lo] + past // self.each[lo], (self.slot[lo] + past % self.each[lo]).astype(np.int32), self.total[lo].astype(np.int32)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack over the numbers of pieces of each length (each from 1 to capacity).

    The fullest feasible combination of what is left is taken out again and again. Once it is the fullest, it stays so for as long as it is feasible, so it is
    taken as often as the counts allow in one step: the number of steps depends on the lengths, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left, reverse=True)
    used = dict.fromkeys(lengths, 0)
    rows, bins = [], 0
    while lengths:
        chosen = fullest(left, lengths, capacity)
        times = min(left[n] // many for n, many in chosen.items())
        total, slot = sum(n * many for n, many in chosen.items()), 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used[n], chosen[n], bins, slot, total))
            slot += chosen[n]
            used[n] += chosen[n] * times
            left[n] -= chosen[n] * times
            if not left[n]:
                lengths.remove(n)
        bins += times
    rows.sort()
    return Plan(*(np.array(rows, np.int64).reshape(-1, 6).T.copy()), bins)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", slice_pieces: int = SLICE_PIECES) -> DataFrame:
    """(bin_id, slot, id, piece, start_token, n_tokens, bin_tokens): where the tokens of every row of docs go.

    Tokens are separated by white space. A text of more than capacity tokens is cut into pieces of capacity tokens and a rest. All pieces of the table are packed together: there are at
    most capacity lengths, so the driver plans bins from the number of pieces of each length (see plan), and pieces take the planned places of their length in the order of
    a hash of (id, piece), then of id and piece. So bins don't depend on partitions or on slice_pieces, and only the last bins are short. bin_tokens is the bin's total, at
    most capacity; bins are numbered from 0 without gaps, and slots within them from 0, longest piece first.

    A piece's rank among those of its length is its rank within a slice of the hash and the number of those in the slices before; no length is gathered in one task, however many pieces
    it has. Only (id, piece, size, hash) is shuffled, once.

    Ties between pieces of a length are broken by the hash; repeated rows are packed one by one, and which of them has which place is not defined, as they are the same.
    Null, empty and blank texts have no tokens and are in no bin. Ids may repeat or be null. Very long texts are many pieces. An empty table gives no rows. Other columns are not read.
    """
    if capacity < 1 or slice_pieces < 1:
        raise ValueError("capacity and slice_pieces must be at least 1")
    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("id"), n_tokens(F.col(text_col)).alias("n")).where("n > 0")
    pieces = sized.select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"), F.xxhash64("id", "piece").alias("h"))
    pieces = written(pieces, "pack-pieces")
    counts = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bits = max(0, -(-sum(counts.values()) // slice_pieces) - 1).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    # the upper bits of the hash in its order; a slice's rows are preceded by the number of those before them
    slice_ = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    each = pieces.withColumn("slice", slice_)
    inside = each.groupBy("n_tokens", "slice").agg(F.count("*").alias("n"))
    before = inside.select("n_tokens", "slice", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("slice")) - F.col("n")).alias("n"))
    heads = before.select("slice", "n_tokens", F.lit(False).alias("is_piece"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("bigint").alias("piece"), "n")
    tails = each.select("slice", "n_tokens", F.lit(True).alias("is_piece"), "h", "id", "piece", F.lit(1).cast("bigint").alias("n"))
    together = heads.unionByName(tails).repartition(1 << bits, "slice")
    rank = F.sum("n").over(Window.partitionBy("slice", "n_tokens").orderBy("is_piece", "h", "id", "piece").rowsBetween(Window.unboundedPreceding, 0)) - 1
    ranked = together.withColumn("rank", rank).where("is_piece").select("id", "piece", "n_tokens", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, slots, totals = shared.value.place(b.column("n_tokens").to_numpy(), b.column("rank").to_numpy())
            start = pa.array(b.column("piece").to_numpy() * capacity)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(slots), b.column("id"), b.column("piece"), start, b.column("n_tokens"), pa.array(totals)], ["bin_id", "slot", "id", "piece", "start_token", "n_tokens", "bin_tokens"])

    out = ranked.mapInArrow(place, f"bin_id bigint, slot int, id {kind}, piece bigint, start_token bigint, n_tokens int, bin_tokens int")
    return out.withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
