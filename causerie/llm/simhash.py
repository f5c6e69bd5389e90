"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.llm.common import fresh, table, written
from causerie.llm.words import Digests

BITS = 128
#: Documents are near-duplicates if at most so many of the first 128 of their 256 bits differ, by which candidates are found,
DISTANCE = 24
#: and at most so many of all 256.
VERIFIED = 42
HALVES = ("f1", "f2", "f3", "f4")
#: Bits in which the codes of a cell agree, at most: what is counted and sent to the driver of such bits has 2**WIDTH rows at most.
WIDTH = 16
#: Bits in a partition, as many as suit the number of codes (see layout).
WIDTHS = range(12, 27)
#: Largest threshold of a partition.
MOST = WIDTH // 2
#: Distinct codes, about, from which costs are estimated; of wider partitions, pairs of the first PROBES of them with all.
SAMPLE = 16_000
PROBES = 500
#: Nanoseconds, about, for a row that is moved, a value that is looked up, a pair that is tested and an entry of a table of values. Results don't depend on them.
ROW_NS, LOOKUP_NS, PAIR_NS, ENTRY_NS = 5000, 7, 20, 25
#: Values that are looked up at a time.
LOOKUPS = 200_000
#: Codes that are compared at a time; a larger cell is compared in blocks of this many.
CELL = 500_000
CANDIDATES = 2_000_000
#: Up to so many dropped rows are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def simhash(texts: list[str | None], known: Digests) -> tuple[np.ndarray, np.ndarray]:
    """Four 64-bit words a text, and whether it has a word at all.

    A bit is set if more than half of the text's distinct words (runs of letters and digits, in lower case) have it in their SHA-256.
    """
    words = [[w.encode() for w in set(WORD.findall(t.lower()))] if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    at = known.indices(words, int(sizes.sum()))
    ends = np.cumsum(sizes)
    ones = np.zeros((len(texts), 2 * BITS), np.int64)
    for k in np.flatnonzero(sizes):
        lo, hi = int(ends[k] - sizes[k]), int(ends[k])
        for i in range(lo, hi, 100_000):
            ones[k] += np.unpackbits(known.rows[at[i : min(i + 100_000, hi)]], axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").astype(np.uint64), sizes > 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, f1, f2, f3, f4) a row; the fingerprint is null if the text has no word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Digests(wide=True)
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                f, some = simhash(part.column("text").to_pylist(), known)
                halves = [pa.array(f[:, k].view(np.int64), mask=~some) for k in range(len(HALVES))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), *halves], ["id", "text_hash", *HALVES])

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(codes, f"id {kind}, text_hash bigint, f1 bigint, f2 bigint, f3 bigint, f4 bigint")


def _bits(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(c).to_numpy().view(np.uint64) for c in HALVES], axis=1)


def unpack(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(f.astype(">u8").view(np.uint8), axis=1)


def correlations(codes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of codes, and how far each two of their bits vary together, from pair counts over all codes."""
    bits = 2 * BITS

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((bits, bits))
        n = 0
        for b in batches:
            f = _bits(b)
            for lo in range(0, len(f), 50_000):
                x = unpack(f[lo : lo + 50_000]).astype(np.float32)
                both += x.T @ x
                n += len(x)
        at = np.arange(bits * bits + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "n"])

    rows = codes.mapInArrow(pairs, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(bits * bits + 1)
    flat[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    n, both = max(flat[-1], 1), flat[:-1].reshape(bits, bits)
    p = np.diag(both) / n
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    return int(flat[-1]), corr


def group_bits(corr: np.ndarray, count: int) -> list[list[int]]:
    """So many partitions of nearly equal width, bits that vary together in one: greedy growth by the sum of correlations."""
    free, groups = list(range(len(corr))), []
    for k in range(count):
        inner = corr[np.ix_(free, free)]
        group = [free.pop(int(inner.max(axis=1).argmax()))]
        while len(group) < -(-(len(free) + len(group)) // (count - k)):
            group.append(free.pop(int(corr[np.ix_(free, group)].sum(1).argmax())))
        groups.append(sorted(group))
    return groups


def values(f: np.ndarray, bits: list[int]) -> np.ndarray:
    """The number that some bits of each code make up; bit 0 is the highest of f1."""
    out = np.zeros(len(f), np.int64)
    for k, b in enumerate(bits):
        out |= ((f[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1)).astype(np.int64) << k
    return out


def histograms(codes: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """How many codes have each value, for lists of at most WIDTH bits."""
    first = np.cumsum([0, *(1 << len(bits) for bits in parts)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros(first[-1], np.int64)
        for b in batches:
            f = _bits(b)
            for k, bits in enumerate(parts):
                hist[first[k] : first[k + 1]] += np.bincount(values(f, bits), minlength=1 << len(bits))
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[at])], ["at", "n"])

    rows = codes.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    hist = np.zeros(first[-1], np.int64)
    hist[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return np.split(hist, first[1:-1])


def _walsh(x: np.ndarray) -> np.ndarray:
    x, h = x.astype(float), 1
    while h < len(x):
        y = x.reshape(-1, 2, h)
        x = np.concatenate([y[:, :1] + y[:, 1:], y[:, :1] - y[:, 1:]], axis=1).reshape(-1)
        h *= 2
    return x


def candidate_counts(hist: np.ndarray) -> np.ndarray:
    """Number of pairs of codes whose values in a partition differ in at most t bits, for t = 0 ... WIDTH.

    The Walsh-Hadamard transform gives how often each difference occurs between two codes.
    """
    apart = _walsh(_walsh(hist) ** 2) / len(hist)
    by = np.bincount(np.bitwise_count(np.arange(len(hist), dtype=np.uint32)), apart, WIDTH + 1)
    by[0] -= hist.sum()
    return np.maximum(np.cumsum(by) / 2, 0)


def allocate(counts: np.ndarray, distance: int) -> list[int]:
    """Thresholds t (-1: not probed) with sum(t + 1) = distance + 1 and the fewest candidates: dynamic programming over partitions.

    If two codes differ in more than t bits in every partition, they differ in at least distance + 1 in all; so
    each pair within the distance is a candidate of some partition. counts: costs by partition and threshold, for thresholds up to MOST.
    """
    most = distance + 1
    best = np.full(most + 1, np.inf)
    best[0], back = 0, []
    for c in counts:
        cost = np.concatenate([[0], c[: MOST + 1]])
        now, choice = np.full(most + 1, np.inf), np.zeros(most + 1, int)
        for s in range(most + 1):
            for t in range(min(s, MOST + 1) + 1):
                if best[s - t] + cost[t] < now[s]:
                    now[s], choice[s] = best[s - t] + cost[t], t
        best = now
        back.append(choice)
    s, out = most, []
    for choice in reversed(back):
        out.append(int(choice[s]) - 1)
        s -= choice[s]
    return out[::-1]


def split(bits: list[int], t: int) -> list[list[int]]:
    """t + 1 parts of a partition's bits: codes within t there agree in one of them. Of a part, WIDTH bits at most."""
    return [[bits[k] for k in part[:WIDTH]] for part in np.array_split(np.arange(len(bits)), t + 1)]


def costs(n: int, width: int, pairs: np.ndarray) -> np.ndarray:
    """Nanoseconds, about, that a partition takes by threshold from 0 to MOST: rows moved, tables, values looked up and candidates in its cells (see Plan).

    n: codes; pairs: how many pairs of them differ in t bits at most of the partition, by t.
    """
    exact, out = np.diff(pairs, prepend=0), []
    for t in range(MOST + 1):
        sizes = [len(part) for part in split(list(range(width)), t)] if t < width else []
        tested = sum(exact[j] * comb(width - s, j) / comb(width, j) for s in sizes for j in range(min(t, width - s) + 1))
        looked_up = sum(comb(width - s, j) for s in sizes for j in range(1, t + 1)) / 2
        out.append(n * (len(sizes) * ROW_NS + looked_up * LOOKUP_NS) + tested * PAIR_NS + len(sizes) * 2**width * ENTRY_NS if sizes else np.inf)
    return np.array(out)


def layout(n: int, distance: int, verified: int) -> tuple[int, int, int]:
    """(bits, partitions, distance over those bits): the first half and its distance or all bits and theirs, whichever costs less if n codes were random.

    Wide partitions have few candidates and many values to look up; the more codes, the wider the partitions that cost least.
    """
    best = (np.inf, BITS, BITS // WIDTH, distance)
    for bits, most in ((BITS, distance), (2 * BITS, verified)):
        for count in sorted({-(-bits // w) for w in WIDTHS}):
            width, (low, more) = -(-bits // count), divmod(most + 1, count)
            if low + (more > 0) > MOST + 1:
                continue
            random = n * n / 2 * np.cumsum([comb(width, t) / 2**width for t in range(width + 1)])
            each = np.concatenate([[0], costs(n, width, random)])
            best = min(best, (float((count - more) * each[low] + (more and more * each[low + 1])), bits, count, most))
    return best[1:]


def near_pairs(f: np.ndarray, bits: list[int], n: int) -> np.ndarray:
    """About how many pairs of n codes differ in at most t of some bits, by t, from a sample: all its pairs if the bits are few."""
    v = values(f, bits)
    if len(bits) <= WIDTH:
        return candidate_counts(np.bincount(v, minlength=1 << len(bits)))[: len(bits) + 1] * (n / max(1, len(f))) ** 2
    apart = np.bitwise_count(v[:PROBES, None] ^ v[None, :])
    found = np.cumsum(np.bincount(apart.ravel(), minlength=len(bits) + 1)) - min(PROBES, len(v))
    return np.maximum(found, 0) * (n * n / 2 / max(1, apart.size))


def cells_of(codes: DataFrame, distance: int, verified: int) -> list[tuple[list[int], list[int], int]]:
    """(bits that agree, the other bits of the partition, its threshold): parts in whose cells all pairs meet that are within distance in the first half and verified in all bits."""
    n, corr = correlations(codes)
    bits, count, most = layout(n, distance, verified)
    groups = group_bits(corr[:bits, :bits], count)
    some = _bits(codes.where(F.pmod(F.xxhash64(*HALVES), F.lit(max(1, n // SAMPLE))) == 0).toArrow())
    thresholds = allocate(np.stack([costs(n, len(g), near_pairs(some, g, n)) for g in groups]), most)
    return [(part, [b for b in g if b not in part], t) for g, t in zip(groups, thresholds) if t >= 0 for part in split(g, t)]


class Plan:
    """Cells: within a partition of threshold t, codes within the threshold agree in one of t + 1 parts of its bits; each value of each part is a cell."""

    def __init__(self, parts: list[tuple[list[int], list[int], int]], sizes: list[np.ndarray], cell: int = CELL) -> None:
        self.parts = parts  # see cells_of
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
        self.sizes = np.concatenate(sizes)
        self.blocks = np.maximum(1, -(-self.sizes // cell))
        self.rows = int((self.sizes * self.blocks).sum())

    def places(self, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(position in f, cell, lower block, upper block): where codes are compared. Two blocks of a cell meet in one place."""
        spread = ((f[:, 0] ^ (f[:, 1] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        everyone = np.arange(len(f))
        for k, (agree, _, _) in enumerate(self.parts):
            cell = self.first[k] + values(f, agree)
            blocks = self.blocks[cell]
            own = (spread % blocks.astype(np.uint64)).astype(np.int64)
            for other in range(int(blocks.max(initial=0))):
                at = everyone[blocks > other]
                yield at, cell[at], np.minimum(own[at], other), np.maximum(own[at], other)

    def part_of(self, cell: int) -> tuple[list[int], list[int], int]:
        return self.parts[int(np.searchsorted(self.first, cell, "right")) - 1]


class Components:
    """Least member of each connected component, as pairs come in."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            least = np.minimum(la, lb)
            np.minimum.at(self.label, la, least)
            np.minimum.at(self.label, lb, least)
            while (self.label != (to := self.label[self.label])).any():
                self.label = to


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """So many numbers from each first on."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


def stretches(many: np.ndarray) -> Iterator[slice]:
    """Slices with a sum of CANDIDATES at most, or of one element."""
    ends = np.cumsum(many)
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CANDIDATES, "right")))
        yield slice(i, j)
        i = j


def compare(f: np.ndarray, free: list[int], t: int, distance: int, verified: int, side: np.ndarray | None) -> Components:
    """Join all codes of a cell that are within distance and verified and, in the free bits of its partition, within t. A group's label is one of its members.

    side: if given, only codes of different sides are compared. Of a value that many codes share, those near the first one are connected through it and not compared
    with each other. Values are looked up in a table of those that there are, by the highest bit in which the two differ; if that would take longer, all codes are compared.
    """
    found, out = Components(len(f)), Components(len(f))
    if len(f) < 2:
        return out
    u = values(f, free)
    order = np.argsort(u, kind="stable")
    u = u[order]
    words = [np.ascontiguousarray(f[order, k]) for k in range(len(HALVES))]
    side = None if side is None else side[order]
    linked: list[tuple[np.ndarray, np.ndarray]] = []

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = min(distance, verified)
        d = np.bitwise_count(words[0][a] ^ words[0][b])
        few = np.flatnonzero(d <= most)
        d = d[few].astype(np.int16)
        for word, most in zip(words[1:], (most, verified, verified)):
            d += np.bitwise_count(word[a[few]] ^ word[b[few]])
            some = d <= most
            few, d = few[some], d[some]
        return few

    def join() -> None:
        if linked:
            found.join(*map(np.concatenate, zip(*linked)))
            linked.clear()

    def test(a: np.ndarray, b: np.ndarray) -> None:
        if side is not None:
            other = side[a] != side[b]
            a, b = a[other], b[other]
        some = near(a, b)
        linked.append((a[some], b[some]))
        if sum(len(x) for x, _ in linked) > CANDIDATES:
            join()

    def block(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, CANDIDATES // max(1, len(b)))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            test(np.repeat(part, len(b)), np.tile(b, len(part)))

    def runs(a: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        for k in stretches(many):
            test(np.repeat(a[k], many[k]), spread(first[k], many[k]))

    def look_up() -> None:
        counts = np.bincount(u, minlength=1 << len(free))
        starts = np.cumsum(counts) - counts
        big = 256
        for v in np.flatnonzero(counts > big) if side is None else []:
            rest = everyone[starts[v] : starts[v] + counts[v]]
            while len(rest) > big:
                first, others = rest[:1], rest[1:]
                like = np.zeros(len(others), bool)
                like[near(np.repeat(first, len(others)), others)] = True
                linked.append((np.repeat(first, like.sum()), others[like]))
                block(others[like], others[~like])
                rest = others[~like]
            block(rest, rest)
        after = starts[u] + counts[u] - everyone - 1
        if side is None:
            after[counts[u] > big] = 0
        some = np.flatnonzero(after)
        runs(some, some + 1, after[some])
        there, single, known = counts > 0, counts == 1, np.flatnonzero(counts)
        for h, masks in enumerate(highest):
            zero = known[known >> h & 1 == 0]
            step = max(1, LOOKUPS // len(masks))
            for lo in range(0, len(zero), step):
                target = zero[lo : lo + step, None] ^ masks
                hit = np.flatnonzero(there[target])
                v, w = zero[lo + hit // len(masks)], target.ravel()[hit]
                one = single[v] & single[w]
                test(starts[v[one]], starts[w[one]])
                v, w = v[~one], w[~one]
                for k in stretches(counts[v]):
                    b = np.repeat(w[k], counts[v[k]])
                    runs(spread(starts[v[k]], counts[v[k]]), starts[b], counts[b])

    everyone = np.arange(len(u))
    highest = [np.array([1 << h | sum(1 << k for k in c) for r in range(t) for c in combinations(range(h), r)]) for h in range(len(free))] if t else []
    if len(u) * PAIR_NS < sum(map(len, highest)) * LOOKUP_NS + (ENTRY_NS << len(free)) / len(u):
        runs(everyone[:-1], everyone[1:], everyone[:0:-1])
    else:
        look_up()
    join()
    out.label[order] = order[found.label]
    return out


def near_edges(codes: DataFrame, distance: int = DISTANCE, verified: int = VERIFIED, cell: int = CELL) -> DataFrame:
    """(u, v): edges between codes (structs) that connect exactly those that are linked by steps of at most distance of the first 128 and verified of all 256 bits.

    Each cell gives a star for each group that it finds, not all pairs of it.
    """
    if not 0 <= distance < BITS // WIDTH * (MOST + 1):
        raise ValueError(f"distance must be from 0 to {BITS // WIDTH * (MOST + 1) - 1}")
    parts = cells_of(codes, distance, verified)
    plan = Plan(parts, histograms(codes, [agree for agree, _, _ in parts]), cell)
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(plan)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan.rows // 1_000_000))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _bits(b)
            for at, c, lo, hi in shared.value.places(f):
                task = ((c * 1_000_003 + lo * 10_007 + hi) % tasks).astype(np.int32)
                cols = [task, c.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), *(np.ascontiguousarray(f[at, k]).view(np.int64) for k in range(len(HALVES)))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["task", "cell", "lo", "hi", *HALVES])

    def meet(t: pa.Table) -> pa.Table:
        cells, lo, hi = (t.column(c).to_numpy() for c in ("cell", "lo", "hi"))
        f = _bits(t)
        order = np.lexsort((*f.T[::-1], hi, lo, cells))
        cells, lo, hi, f = cells[order], lo[order], hi[order], f[order]
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        a, b = [], []
        for i, j in zip([0, *cuts], [*cuts, len(f)]):
            if j - i < 2:
                continue
            _, free, limit = shared.value.part_of(int(cells[i]))
            side = None
            if lo[i] != hi[i]:
                own = shared.value.blocks[cells[i]]
                mine = f[i:j]
                spread = ((mine[:, 0] ^ (mine[:, 1] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                side = (spread % np.uint64(own)).astype(np.int64) == lo[i]
            label = compare(f[i:j], free, limit, distance, verified, side).label
            moved = np.flatnonzero(label != np.arange(j - i))
            a.append(f[i:j][moved])
            b.append(f[i:j][label[moved]])
        ends = [np.concatenate(x) if x else np.empty((0, len(HALVES)), np.uint64) for x in (a, b)]
        return pa.table({f"{n}{k + 1}": np.ascontiguousarray(x[:, k]).view(np.int64) for n, x in zip("ab", ends) for k in range(len(HALVES))})

    placed = codes.mapInArrow(place, "task int, cell int, lo int, hi int, f1 bigint, f2 bigint, f3 bigint, f4 bigint")
    met = placed.groupBy("task").applyInArrow(meet, ", ".join(f"{n}{k + 1} bigint" for n in "ab" for k in range(len(HALVES)))).distinct()
    code = lambda n: F.struct(*(F.col(f"{n}{k + 1}").alias(h) for k, h in enumerate(HALVES)))
    return met.select(code("a").alias("u"), code("b").alias("v"))


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) from edges (u, v) of any comparable type: for each node that isn't the least of its component, the least one.

    Large-star and small-star steps in turn, each result written, until nothing changes: a number of rounds that grows with the
    logarithm of the longest path.
    """

    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mins(both).select("u", F.least("m", "u").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        each = down.join(mins(down), "u")
        return each.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(each.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.where("u <> v").distinct(), "components")
    before = None
    while (after := state(now)) != before:
        before = after
        now = written(small(large(now)), "components")
    return now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, verified: int = VERIFIED, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(id, group_id, kept) for every row of docs. See _grouped for columns by which rows can be told apart.

    Two documents are linked if at most distance of their first 128 SimHash bits and at most verified of all 256 differ (see simhash); a group is all that hangs
    together by links. group_id is the least id of the group, and the row with it is the one kept. All such pairs are found: the candidates of general pigeonhole
    partitions of the first 128 bits (see allocate), each verified on all bits. Equal fingerprints are taken together first, so copies cost nothing.

    Texts without a word (null, empty, only punctuation) have no fingerprint: each is a group of its own and kept. Null ids come last in a group.
    Of repeated rows one is kept. An empty table gives no rows. Other columns are not read. Text is read once; only ids and fingerprints are shuffled.
    """
    return _grouped(docs, distance, verified, id_col, text_col, cell).select(F.col("id").alias(id_col), "group_id", "kept")


def _grouped(docs: DataFrame, distance: int, verified: int, id_col: str, text_col: str, cell: int) -> DataFrame:
    """(id, text_hash, group_id, kept)"""
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    with_words = rows.where("f1 IS NOT NULL")
    codes = written(with_words.select(*HALVES).distinct(), "codes")
    root = connected(near_edges(codes, distance, verified, cell)).select("u.*", F.col("v").alias("root"))
    led = with_words.join(root, list(HALVES), "left").withColumn("root", F.coalesce("root", F.struct(*HALVES)))
    inside = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "text_hash")
    grouped = led.select("id", "text_hash", F.first("id").over(inside).alias("group_id"), (F.row_number().over(inside) == 1).alias("kept"))
    alone = rows.where("f1 IS NULL").select("id", "text_hash", F.col("id").alias("group_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def keep_one_each(docs: DataFrame, distance: int = DISTANCE, verified: int = VERIFIED, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns.

    The keys (id, hash of the text) of dropped rows are taken out by an anti join: broadcast up to a number of rows that is counted, shuffled beyond it. Where
    some rows of a key are dropped and one is kept, those few rows are numbered, by the hash of their other columns, and the first is taken: which one doesn't depend on partitions.

    Texts without a word are kept, repeated ones too. Very long texts are read whole. An empty table gives no rows. Other columns may have any name.
    """
    marked = written(_grouped(docs, distance, verified, id_col, text_col, cell), "simhash-groups")
    id_, hash_, number = fresh(docs, "key_id", "key_hash", "key_number")
    keys = marked.groupBy(F.col("id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.max("kept").alias("one"), F.min("kept").alias("all"))
    keys = written(keys.where("NOT all"), "simhash-drop")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = docs[id_col].eqNullSafe(keys[id_]) & (F.xxhash64(docs[text_col]) == keys[hash_])
    rest = docs.join(keys, same, "left_anti")
    repeated = keys.where("one")
    if repeated.isEmpty():
        return rest
    again = docs.join(repeated, same, "left_semi")
    one = again.withColumn(number, F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in docs.columns if c not in (id_col, text_col)))))).where(F.col(number) == 1)
    return rest.unionByName(one.drop(number))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op8_simhash_near_duplicates": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM documents),
        hashed AS (SELECT w, unnest([1, 2, 3, 4]) AS k, unnest([CAST('0x' || substr(x, 1, 16) AS UBIGINT), CAST('0x' || substr(x, 17, 16) AS UBIGINT), CAST('0x' || substr(x, 33, 16) AS UBIGINT), CAST('0x' || substr(x, 49, 16) AS UBIGINT)]) AS h FROM (SELECT w, sha256(w) AS x FROM (SELECT DISTINCT w FROM words))),
        bits AS (SELECT w, k, j, CAST((h >> j) & 1 AS INTEGER) AS b FROM hashed, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS j)),
        votes AS (SELECT doc_id, k, j, 2 * sum(b) > count(*) AS v FROM words JOIN bits USING (w) GROUP BY doc_id, k, j),
        codes AS (
            SELECT doc_id, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY k, j) FILTER (k <= 2)::BIT AS f, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY k, j)::BIT AS f_all
            FROM votes GROUP BY doc_id),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM codes a, codes b WHERE bit_count(xor(a.f, b.f)) <= {DISTANCE} AND bit_count(xor(a.f_all, b.f_all)) <= {VERIFIED}),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(g.group_id, d.doc_id) AS group_id, coalesce(g.group_id, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN groups g ON d.doc_id = g.a
    """
}
QUERIES = {"op8_simhash_near_duplicates": op8_simhash_near_duplicates}
