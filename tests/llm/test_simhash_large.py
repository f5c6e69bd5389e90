from collections import Counter

import numpy as np
import pytest

from causerie.llm import simhash as sh
from tests.llm.test_simhash import brute, docs, texts


def compared_with(n, thresholds, groups):
    """Random codes that a code is compared with among n, on average, over all cells."""
    f = np.random.default_rng(1).integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    pairs = 0
    for g, t in zip(groups, thresholds):
        v = sh.values(f, g)
        apart = v[:, None] ^ v
        near = np.bitwise_count(apart) <= t
        for part in sh.split(list(range(len(g))), t) if t >= 0 else []:
            pairs += int((near & (apart & sum(1 << k for k in part) == 0)).sum()) - len(f)
    return pairs / len(f) ** 2 * n / 2


def test_pairs_tested_grow_slower_than_the_table():
    def each(n):
        bits, count, most = sh.layout(n, sh.DISTANCE, sh.VERIFIED)
        groups = [list(map(int, g)) for g in np.array_split(np.arange(bits), count)]
        random = [n * n / 2 * np.cumsum([sh.comb(len(g), t) / 2 ** len(g) for t in range(len(g) + 1)]) for g in groups]
        return compared_with(n, sh.allocate(np.stack([sh.costs(n, len(g), p) for g, p in zip(groups, random)]), most), groups)

    small, large = each(236_000), each(2_800_000)
    assert large < 6 * small and large < 12_000


@pytest.mark.parametrize("cell", [50, sh.CELL])
def test_wide_partitions_of_all_bits_find_the_same_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(sh, "layout", lambda n, distance, verified: (2 * sh.BITS, 11, verified))
    rows = texts()
    assert Counter((r.doc_id, r.group_id, r.kept) for r in sh.near_duplicates(docs(spark, rows), cell=cell).collect()) == brute(rows, sh.DISTANCE)


@pytest.mark.parametrize("table", [True, False])
@pytest.mark.parametrize("sides", [True, False])
def test_a_cell_links_what_brute_force_links(monkeypatch, table, sides):
    monkeypatch.setattr(sh, "PAIR_NS", 10**9 if table else 0)
    rng = np.random.default_rng(4)
    for free, t in ((4, 0), (9, 2), (13, 3)):
        f = rng.integers(0, 1 << 63, (150, 4)).astype(np.uint64)[rng.integers(0, 150, 700)]
        for k in range(len(f)):
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                f[k, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(b)
        side = rng.integers(0, 2, len(f)) == 0 if sides else None
        label = sh.compare(f, list(range(free)), t, 8, 12, side).label
        apart = np.bitwise_count(f[:, None] ^ f).astype(int)
        linked = (apart[:, :, :2].sum(2) <= 8) & (apart.sum(2) <= 12)
        if sides:
            linked &= side[:, None] != side
        u = sh.values(f, list(range(free)))
        together = label[:, None] == label
        assert together[linked & (np.bitwise_count(u[:, None] ^ u) <= t)].all()
        whole = sh.Components(len(f))
        whole.join(*np.nonzero(linked))
        assert (whole.label[:, None] == whole.label)[together].all()
