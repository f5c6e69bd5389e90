import math
from collections import Counter
from hashlib import md5

from causerie.llm import mixing


def brute(rows, budgets, weights=None):
    tokens = lambda t: len((t or "").encode().split())
    has = Counter()
    for _, t, s in rows:
        has[s] += tokens(t)
    w = {s: float(math.floor(math.sqrt(n))) if weights is None else float(weights.get(s, 0)) for s, n in has.items()}
    out = Counter()
    for i, t, s in rows:
        h = lambda j: int(md5(("" if j is None else str(j)).encode()).hexdigest()[:15], 16)
        so_far = sum(tokens(u) for j, u, r in rows if r == s and h(j) <= h(i))
        for b in budgets:
            part = math.floor(sum(has.values()) * b * w[s] / sum(w.values())) if sum(w.values()) else 0
            # hashes below the first at which the budget is exceeded
            if so_far <= part:
                out[i, s, tokens(t), b] += 1
                break
    return out


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, h int, threshold int")


ROWS = [(i, "w " * (1 + i % 7), f"s{i % 3 if i % 5 else 0}") for i in range(120)] + [(None, "a b", "s1"), (200, None, "s1"), (201, "", None), (202, "x y z", None), (5, "w " * 6, "s0"), (203, "long " * 5000, "s9")]


def test_as_brute_force(spark):
    for weights in (None, {"s0": 1, "s1": 3.5}):
        got = Counter(tuple(r) for r in mixing.mix(docs(spark, ROWS), (0.25, 0.5, 1.0), weights).collect())
        assert got == brute(ROWS, (0.25, 0.5, 1.0), weights)


def test_filter_and_empty(spark):
    kept = mixing.keep_mix(docs(spark, ROWS), 0.5)
    assert kept.columns == ["doc_id", "text", "source", "h", "threshold"]
    want = Counter()
    for (i, s, _, _), n in brute(ROWS, (0.5,)).items():
        want[i, s] += n
    assert Counter((r.doc_id, r.source) for r in kept.collect()) == want
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.keep_mix(docs(spark, [])).collect() == []
