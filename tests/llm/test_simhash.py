import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causerie.llm import simhash as sh
from causerie.llm.words import Digests


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        base = [word() for _ in range(120)]
        rows.append((1000 - i, " ".join(base)))
        for c in range(i % 4):
            copy = list(base)
            for _ in range(1 + 3 * c):
                copy[rng.randrange(120)] = word()
            rows.append((2000 + 10 * i + c, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, "?! ..."), (None, rows[0][1]), (5, rows[0][1].upper()), (rows[0][0], rows[0][1]), (7, "w" * 100_000), (8, "w" * 100_000)]
    return rows


def brute(rows, distance, verified=sh.VERIFIED):
    f, some = sh.simhash([t for _, t in rows], Digests(wide=True))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if some[i] and some[j] and int(np.bitwise_count(f[i, :2] ^ f[j, :2]).sum()) <= distance and int(np.bitwise_count(f[i] ^ f[j]).sum()) <= verified and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, []).append(rows[k][0])
    out = Counter()
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            out[i, ids[0], n == 0] += 1
    return out


def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id bigint, text string, group_id int, f1 string")


def test_groups_are_those_of_brute_force(spark):
    rows = texts()
    for distance, cell in ((sh.DISTANCE, 50), (sh.DISTANCE, sh.CELL), (3, sh.CELL)):
        got = Counter((r.doc_id, r.group_id, r.kept) for r in sh.near_duplicates(docs(spark, rows), distance, cell=cell).collect())
        assert got == brute(rows, distance)


def test_filter_keeps_whole_rows(spark):
    rows = texts()
    kept = sh.keep_one_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "group_id", "f1"]
    want = Counter()
    for (i, _, keep), n in brute(rows, sh.DISTANCE).items():
        want[i] += n * keep
    assert Counter(r.doc_id for r in kept.collect()) == +want


def test_empty(spark):
    assert sh.near_duplicates(docs(spark, [])).collect() == [] and sh.keep_one_each(docs(spark, [])).collect() == []


def test_hot_values(spark):
    rng = np.random.default_rng(5)
    f = np.zeros((900, 4), np.uint64)
    for k in range(900):
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            f[k, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(b)
    f[450:, 0] ^= np.uint64(0xFFFFFFFF)
    label = sh.compare(f, list(range(8)), 8, 6, 6, None).label
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    want = sh.Components(900)
    want.join(*np.nonzero(d <= 6))
    assert len(set(zip(label.tolist(), want.label.tolist()))) == len(set(label.tolist())) == len(set(want.label.tolist()))


@settings(deadline=None, max_examples=30)
@given(st.lists(st.lists(st.integers(0, 50), min_size=sh.WIDTH + 1, max_size=sh.WIDTH + 1).map(lambda x: np.cumsum(x).astype(float)), min_size=2, max_size=4), st.integers(0, 6))
def test_allocation_is_the_cheapest(counts, distance):
    from itertools import product

    got = sh.allocate(np.stack(counts), distance)
    cost = lambda ts: sum(0 if t < 0 else c[t] for c, t in zip(counts, ts))
    assert sum(t + 1 for t in got) == distance + 1
    assert cost(got) == min(cost(ts) for ts in product(range(-1, distance + 1), repeat=len(counts)) if sum(t + 1 for t in ts) == distance + 1)


def test_candidate_counts():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << sh.WIDTH, 300)
    v[:50] = v[0]
    got = sh.candidate_counts(np.bincount(v, minlength=1 << sh.WIDTH))
    d = np.bitwise_count((v[:, None] ^ v[None]).astype(np.uint32))[np.triu_indices(300, 1)]
    assert np.allclose(got, [(d <= t).sum() for t in range(sh.WIDTH + 1)])
