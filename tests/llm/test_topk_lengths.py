import numpy as np

from causerie.llm import topk
from tests.llm.test_topk import brute, frame, got


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)).astype(np.float32))]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(25, 3)).astype(np.float32))] + [(200, [1.0]), (300, [1.0, 2.0]), (301, [4.0, 6.0])]
    rows += [(400 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 700)).astype(np.float32))]
    found = got(topk.top_k(frame(spark, rows), 4, query_bytes=40_000))
    want = [r for dims in (8, 3, 2) for r in brute(rows, 4, dims)]
    assert [r for r in found if r[0] < 400] == sorted(want)
    long = [r for r in found if r[0] >= 400]
    assert [r[:3] for r in long] == [r[:3] for r in brute(rows, 4, 700)] and len(long) == 48
