import numpy as np
import pytest
from pyspark.sql import functions as F

from causerie.llm import topk


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "a", None) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, rank int, block string, q string")


def brute(rows, k, dims, every=1, kind=np.float32):
    good = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted((round(float(((q - x) ** 2).sum()), 9), j) for j, x in good if j != i)[:k]
            out += [(i, r + 1, j, round(d**0.5, 6)) for r, (d, j) in enumerate(near)]
    return sorted(out)


def got(found):
    return sorted((r.query_id, r.rank, r.neighbour_id, round(r.distance, 6)) for r in found.collect())


@pytest.mark.parametrize("dims,every,query_bytes", [(3, 1, 1900), (40, 1, 16 << 20), (40, 7, 4000)])
def test_as_brute_force(spark, dims, every, query_bytes):
    rng = np.random.default_rng(dims)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, dims)).astype(np.float32))]
    rows += [(210, rows[3][1]), (217, rows[3][1]), (7, rows[7][1]), (None, rows[1][1]), (202, None), (203, [1.0]), (204, [float("nan")] * dims), (205, [None] * dims), (206, [])]
    found = topk.top_k(frame(spark, rows), 5, F.col("vec_id") % every == 0, query_bytes=query_bytes, task_rows=40)
    assert got(found) == brute(rows, 5, dims, every)


def test_bounds_drop_most_pairs_of_vectors_with_structure(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(100, 64)) * 3)[rng.integers(0, 100, 3000)] + rng.normal(size=(3000, 64)) * 0.2
    mean, spread = x.mean(0), np.cov(x.T)
    axes = np.linalg.eigh(spread)[1][:, ::-1].copy()
    q = topk.Columns(np.arange(0, 3000, 10), np.ascontiguousarray(x[::10].T), mean, axes)
    found = topk.Nearest(topk.Group(q, mean, axes, topk.bounds(q, 5)), 5)
    for lo in range(0, 3000, 500):  # bounds get better from block to block
        found.search(topk.Columns(np.arange(lo, lo + 500), np.ascontiguousarray(x[lo : lo + 500].T), mean, axes))
    near = np.sort(((x[::10, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert np.allclose(found.best, near)
    assert found.left[1:7].sum() and found.left[-1] < 0.05 * found.pairs and found.pairs == 300 * 3000


def test_doubles_are_kept(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (1e6 + v * 1e-4).tolist()) for i, v in enumerate(rng.normal(size=(60, 20)))]
    near = {}
    for i, q in rows:
        near[i] = [j for _, j in sorted((float(((np.array(q) - np.array(v)) ** 2).sum()), j) for j, v in rows if j != i)[:3]]
    found = topk.top_k(frame(spark, rows, "double"), 3).collect()
    assert all(near[r.query_id][r.rank - 1] == r.neighbour_id for r in found) and len(found) == 180
    huge = topk.top_k(frame(spark, [(1, [1e200]), (2, [1.0]), (3, [4.0])], "double"), 3)
    assert got(huge) == [(2, 1, 3, 3.0), (3, 1, 2, 3.0)]


def test_few_and_none(spark):
    assert topk.top_k(frame(spark, []), 3).collect() == []
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0])]
    assert got(topk.top_k(frame(spark, rows), 3)) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert topk.top_k(frame(spark, rows), 3, F.col("vec_id") > 5).collect() == []
    assert got(topk.top_k(frame(spark, [(i, [1.0] * 9) for i in (4, 4, 5, 6)]), 2, F.col("q") == "x")) == []
    same = got(topk.top_k(frame(spark, [(i, [1.0] * 9) for i in (4, 4, 5, 6)]), 2))
    assert same == [(4, 1, 5, 0), (4, 1, 5, 0), (4, 2, 6, 0), (4, 2, 6, 0), (5, 1, 4, 0), (5, 2, 4, 0), (6, 1, 4, 0), (6, 2, 4, 0)]
    with pytest.raises(ValueError):
        topk.top_k(frame(spark, rows), 3, id_col="block")
