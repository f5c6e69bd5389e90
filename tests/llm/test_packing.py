from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causerie.llm import packing


def fullest_brute(sizes, capacity):
    return max(s for r in range(len(sizes) + 1) for c in combinations(sizes, r) if (s := sum(c)) <= capacity)


def bins_of(sizes, capacity):
    """Bins as lists of sizes, in order."""
    p = packing.plan(Counter(sizes), capacity)
    lengths = np.array(sorted(sizes, reverse=True), np.int64)
    ranks = np.concatenate([np.arange(n) for _, n in sorted(Counter(sizes).items(), reverse=True)])
    bins, slots, totals = p.place(lengths, ranks)
    out = defaultdict(dict)
    for n, b, s, t in zip(lengths.tolist(), bins.tolist(), slots.tolist(), totals.tolist()):
        assert s not in out[b]
        out[b][s] = (n, t)
    assert sorted(out) == list(range(p.bins))
    for b in out.values():
        assert sorted(b) == list(range(len(b))) and {t for _, t in b.values()} == {sum(n for n, _ in b.values())}
        assert [b[s][0] for s in range(len(b))] == sorted((n for n, _ in b.values()), reverse=True)
    return [[n for n, _ in out[b].values()] for b in range(p.bins)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=10), st.integers(12, 20))
def test_each_bin_is_the_fullest_of_what_is_left(sizes, capacity):
    left = list(sizes)
    for b in bins_of(sizes, capacity):
        assert sum(b) == fullest_brute(left, capacity)
        for n in b:
            left.remove(n)
    assert not left


def test_steps_do_not_grow_with_the_number_of_pieces():
    rng = np.random.default_rng(1)
    few = Counter(rng.integers(1, 300, 2000).tolist())
    small, large = packing.plan(few, 1000), packing.plan({n: c * 1_000_003 for n, c in few.items()}, 1000)
    assert len(large.length) < 6 * len(small.length) and large.bins >= 1_000_003 * (small.bins - 1)
    assert (large.total[np.argsort(large.first)] == 1000).mean() > 0.9


ROWS = [(1, "a " * 25), (2, "b b b"), (3, ""), (4, None), (5, " \n"), (None, "c c c c"), (6, "d d d d d d"), (2, "b b b"), (7, "e")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, 9, 9, "h", "r") for a, b in rows], "doc_id bigint, text string, n_tokens int, slot int, h string, rank string")


def test_pack(spark):
    rows = packing.pack(docs(spark), 10).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for members in bins.values():
        assert sum(r.n_tokens for r in members) == members[0].bin_tokens <= 10
        assert sorted(r.slot for r in members) == list(range(len(members)))
    pieces = Counter((r.doc_id, r.start_token, r.n_tokens) for r in rows)
    assert pieces == Counter({(1, 0, 10): 1, (1, 10, 10): 1, (1, 20, 5): 1, (2, 0, 3): 2, (None, 0, 4): 1, (6, 0, 6): 1, (7, 0, 1): 1})
    # 10, 10, 6 + 4, then 5 + 3 + 1 is the fullest of 5, 3, 3, 1, and 3 is left
    assert [bins[i][0].bin_tokens for i in sorted(bins)] == [10, 10, 10, 9, 3]


def test_bins_do_not_depend_on_slices_or_partitions(spark):
    many = [(i % 290, "w " * (1 + i % 9)) for i in range(300)] + [(1000 + i, "w " * 10) for i in range(150)]
    whole = packing.pack(docs(spark, many), 10).collect()
    assert sorted(map(tuple, packing.pack(docs(spark, many).repartition(7), 10, slice_pieces=20).collect())) == sorted(map(tuple, whole))
    got = defaultdict(list)
    for r in whole:
        got[r.bin_id].append(r.n_tokens)
    assert [sorted(got[b]) for b in sorted(got)] == [sorted(b) for b in bins_of([len(t.split()) for _, t in many], 10)]
    assert Counter((r.doc_id, r.n_tokens) for r in whole) == Counter((i, len(t.split())) for i, t in many)


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), 10).collect() == []
    assert packing.pack(docs(spark, [(1, None), (2, " ")]), 10).collect() == []
