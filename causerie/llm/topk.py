"""Exact top-k search: columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causerie.llm.common import table, written
from causerie.shipping import new_path

K = 10
#: Queries are the rows whose id this divides.
EVERY = 50
DIMS_AT_A_TIME = 8
QUERIES_AT_A_TIME = 256
#: Bytes of the queries that are broadcast at a time; all rows are read once for each such group of queries.
QUERY_BYTES = 16 << 20
#: First bounds of a query come from so many other queries.
SEEDS = 8192
#: While more than this share of pairs is left, a block of dimensions is added to all by one matrix product; below it, those left are moved together.
FEW = 0.02
#: With fewer input partitions than rows / TASK_ROWS, and than four a core, rows are dealt out again.
TASK_ROWS = 2048
INFINITE = 1e150
FOUND = "no int, query_id bigint, neighbour_id bigint, square double"
OUT = "query_id bigint, rank int, neighbour_id bigint, distance double"


class Columns:
    """Vectors in vertical layout (dimensions x rows): as they are, and turned to the axes in which most of their spread comes first.

    mass: the length of what remains of each after every DIMS_AT_A_TIME dimensions.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.y = axes.T @ (x - mean[:, None])
        starts = np.arange(0, len(x), DIMS_AT_A_TIME)
        blocks = np.add.reduceat(self.y**2, starts, axis=0)
        self.mass = np.sqrt(np.concatenate([np.cumsum(blocks[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]))]))


@dataclass
class Group:
    """Queries that are searched for together, with an upper bound of the square of each one's k-th distance."""

    queries: Columns
    mean: np.ndarray
    axes: np.ndarray
    bound: np.ndarray


def slack(a: np.ndarray, most: float) -> np.ndarray:
    """For rounding, of squares of distances between vectors of length a and at most most."""
    return 1e-9 * (a + most) ** 2


def bounds(q: Columns, k: int, seeds: int = SEEDS) -> np.ndarray:
    """The k-th least square of the distance to the first seeds queries of other ids: no less than that to all rows."""
    s_ids, s, own = q.ids[:seeds], q.y[:, :seeds], q.mass[0] ** 2
    out = np.full(len(q.ids), np.inf)
    if len(s_ids) > k:
        for lo in range(0, len(out), QUERIES_AT_A_TIME):
            hi = min(lo + QUERIES_AT_A_TIME, len(out))
            d = own[lo:hi, None] + own[None, : len(s_ids)] - 2 * (q.y[:, lo:hi].T @ s)
            d[q.ids[lo:hi, None] == s_ids[None, :]] = np.inf
            out[lo:hi] = np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0)
    return out + slack(q.mass[0], q.mass[0, : len(s_ids)].max(initial=0))


class Nearest:
    """The k nearest rows seen by a task, of those within the bounds, for each query of a group."""

    def __init__(self, group: Group, k: int) -> None:
        self.q, self.k, self.limit = group.queries, k, group.bound.copy()
        self.best = np.full((len(self.limit), k), np.inf)
        self.who = np.full((len(self.limit), k), np.iinfo(np.int64).max)
        #: Pairs, and those of them that were left after each block of dimensions; pairs of blocks that stopped before count with what was left then.
        self.pairs, self.left = 0, np.zeros(len(self.q.mass), np.int64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = np.isfinite(self.best)
        no = np.nonzero(some)[0]
        arrays = [no.astype(np.int32), self.q.ids[no], self.who[some], self.best[some]]
        for lo in range(0, len(no), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]) for a in arrays], ["no", "query_id", "neighbour_id", "square"])

    def search(self, x: Columns) -> None:
        for lo in range(0, len(self.q.ids), QUERIES_AT_A_TIME):
            self._search(x, lo, min(lo + QUERIES_AT_A_TIME, len(self.q.ids)))

    def _search(self, x: Columns, lo: int, hi: int) -> None:
        """Products are added up some dimensions at a time. Of the dimensions to come, q x is at most |q| |x| of them, so that
        |q - x|^2 is at least |q|^2 + |x|^2 - 2 (the sum so far + |q| |x|). A pair for which that is above the query's limit is dropped.
        """
        q, dims, step = self.q, len(x.x), 0
        last = len(q.mass) - 1
        limit = self.limit[lo:hi] + slack(q.mass[0, lo:hi], x.mass[0].max(initial=0))
        need = (q.mass[0, lo:hi] ** 2 - limit) / 2  # what the sum must reach, less |x|^2 / 2
        half = x.mass[0] ** 2 / 2

        def alive(to: slice, product: np.ndarray) -> np.ndarray:
            most = q.mass[step, lo:hi][:, None] * x.mass[step, to][None, :]
            most += product
            most -= half[None, to]
            return most >= need[:, None]

        product = np.zeros((hi - lo, len(x.ids)))
        probe = slice(0, 256)
        while True:
            at = slice(step * DIMS_AT_A_TIME, min((step + 1) * DIMS_AT_A_TIME, dims))
            product += q.y[at, lo:hi].T @ x.y[at]
            step += 1
            if step == last or alive(probe, product[:, probe]).mean() <= FEW:
                break
        who, cand = np.nonzero(alive(slice(None), product))
        so_far = product[who, cand]
        self.pairs += product.size
        self.left[step] += len(who)
        while step < last:
            for j in range(step * DIMS_AT_A_TIME, min((step + 1) * DIMS_AT_A_TIME, dims)):
                so_far += q.y[j, lo + who] * x.y[j, cand]
            step += 1
            left = so_far + q.mass[step, lo + who] * x.mass[step, cand] - half[cand] >= need[who]
            who, cand, so_far = who[left], cand[left], so_far[left]
            self.left[step] += len(who)
        other = q.ids[lo + who] != x.ids[cand]
        who, cand = who[other], cand[other]
        exact = np.zeros(len(who))  # of vectors as they are, in one order of additions for all, so that equal vectors are at equal distances
        for j in range(dims):
            exact += (x.x[j, cand] - q.x[j, lo + who]) ** 2
        n, k = hi - lo, self.k
        owner = np.concatenate([np.repeat(np.arange(n), k), who])
        dist = np.concatenate([self.best[lo:hi].ravel(), exact])
        ids = np.concatenate([self.who[lo:hi].ravel(), x.ids[cand]])
        order = np.lexsort((ids, dist, owner))
        first = np.searchsorted(owner[order], np.arange(n))
        pick = order[first[:, None] + np.arange(k)[None, :]]
        self.best[lo:hi], self.who[lo:hi] = dist[pick], ids[pick]
        np.minimum(self.limit[lo:hi], self.best[lo:hi, -1], out=self.limit[lo:hi])


def _vectors(b: pa.RecordBatch | pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids, and vectors as dimensions x rows."""
    v = b.column("v")
    v = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()
    return b.column("id").to_numpy(), np.ascontiguousarray(v.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims).T)


def axes_of(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of all rows, from sums over partitions, half a matrix each."""
    upper = np.triu_indices(dims + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            _, x = _vectors(b, dims)
            x = np.concatenate([x, np.ones((1, x.shape[1]))])
            total += x @ x.T
        half = total[upper]
        for lo in range(0, len(half), 100_000):
            part = half[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), pa.array(part)], ["at", "s"])

    got = rows.mapInArrow(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    half = np.zeros(len(upper[0]))
    half[got.column("at").to_numpy()] = got.column("s").to_numpy()
    total = np.zeros((dims + 1, dims + 1))
    total[upper] = total.T[upper] = half / max(half[-1], 1)
    mean = total[-1, :-1]
    spread = total[:-1, :-1] - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return np.zeros(dims), np.eye(dims)
    return mean, np.linalg.eigh(spread)[1][:, ::-1].copy()


def top_k(vectors: DataFrame, k: int = K, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of vectors by Euclidean distance, exactly, for each row of vectors that meets queries (without it, for each row).

    Ranks go by distance, then by id. A row is no neighbour of a row of its own id. With fewer than k others, all are given.

    Queries are searched for in groups of at most query_bytes, which are broadcast; their number and size are counted first. For each group all rows are read once, where they lie: a task turns
    its rows to their principal axes, a batch at a time in vertical layout, and bounds each pair's distance by the mass that remains. Bounds begin with those from other queries, so a task
    gives out only rows that may be among the nearest; the best of all tasks are found by query. Vectors are shuffled only if there are fewer input partitions than the cluster has cores for.

    Numbers of other types than float are taken as doubles; ids must be integers. Left out as queries and as neighbours: null ids, null vectors, vectors without numbers or with a null, NaN or one of
    1e150 or more in size. Vectors of different lengths, of any length, have no distance: each length is searched by itself, one after the other, and a row's neighbours are of its own length. Repeated rows are
    rows of their own, each with neighbours of other ids. An empty table gives no rows. Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids must be integers, not {vectors.schema[id_col].dataType.simpleString()}")
    wanted = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    element = getattr(vectors.schema[vec_col].dataType, "elementType", None)
    v = F.col(vec_col) if isinstance(element, T.FloatType) else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), wanted.alias("q")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(INFINITE))))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_if("q").alias("queries")).where("n > 1 AND queries > 0").orderBy("dims").collect()
    found = [_of_one_length(rows.where(F.size("v") == r["dims"]), r["dims"], r["n"], r["queries"], k, query_bytes, task_rows) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], OUT)


def _of_one_length(rows: DataFrame, dims: int, n: int, n_queries: int, k: int, query_bytes: int, task_rows: int) -> DataFrame:
    """top_k of n rows (id, v, q), all of dims numbers."""
    spark = rows.sparkSession
    every = rows.select("id", "v")
    mean, axes = axes_of(every, dims)
    groups = -(-n_queries * dims * 8 // query_bytes)
    # dealt out in turn, so that groups are of one size whatever the rows are
    asked = written(rows.where("q").select("id", "v").repartition(groups).withColumn("g", F.spark_partition_id()), "top-k-queries")
    tasks = min(-(-n // task_rows), 4 * spark.sparkContext.defaultParallelism)
    if every.rdd.getNumPartitions() < tasks:
        every = every.repartition(tasks)

    def search(g: int) -> DataFrame:
        ids, x = _vectors(asked.where(F.col("g") == g).select("id", "v").toArrow(), dims)
        q = Columns(ids, x, mean, axes)
        shared = spark.sparkContext.broadcast(Group(q, mean, axes, bounds(q, k)))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = shared.value
            found = Nearest(group, k)
            for b in batches:
                found.search(Columns(*_vectors(b, dims), group.mean, group.axes))
            yield from found.rows()

        by = Window.partitionBy("no").orderBy("square", "neighbour_id")
        ranked = every.mapInArrow(nearest, FOUND).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "neighbour_id", F.sqrt("square").alias("distance"))

    if groups == 1:
        return search(0)
    path = new_path(spark, "top-k")
    for g in range(groups):
        search(g).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    found = top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % EVERY == 0)
    return found.withColumn("distance", F.round("distance", 6))


SQL = {
    "op5_exact_top_k": f"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS r FROM pairs)
        SELECT query_id, CAST(r AS INTEGER) AS rank, neighbour_id, round(d, 6) AS distance FROM ranked WHERE r <= {K}
    """
}
QUERIES = {"op5_exact_top_k": op5_exact_top_k}
