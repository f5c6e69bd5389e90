import random
from collections import Counter
from hashlib import md5

import pytest

from causerie.llm import fingerprints as fp

ROWS = [(1, "a b c d e f g"), (2, "A  b\tc d e\nf g h"), (3, "x y"), (4, ""), (5, None), (None, "  \n "), (7, "one " * 5000), (1, "a b c d e f g")]


def brute(text, shingle, scaled):
    words = (text or "").lower().encode().split()
    out = set()
    for i in range(max(len(words) - shingle + 1, 1) if words else 0):
        h = 0
        for half in range(2):
            total = sum(int(md5(w).hexdigest()[8 * half : 8 * half + 8], 16) % fp.PRIME * fp.MULTIPLIERS[half][k] for k, w in enumerate(words[i : i + shingle])) % fp.PRIME
            h = (h << 31) + total
        if h < fp.limit(scaled):
            out.add(h)
    return len(words), sorted(out)


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id bigint, text string, hashes int, scaled string")


def test_sketch_is_that_of_brute_force(spark):
    for scaled in (1, 3):
        got = sorted((str(r.doc_id), r.n_words, r.hashes) for r in fp.sketch(docs(spark), 3, scaled).collect())
        assert got == sorted((str(i), *brute(t, 3, scaled)) for i, t in ROWS)


def test_empty_table(spark):
    assert fp.sketch(docs(spark, [])).collect() == []


def brute_pairs(rows, shingle, scaled, at_least):
    """Classes of equal sketches, and pairs of them."""
    of = {}
    for i, t in rows:
        if h := tuple(brute(t, shingle, scaled)[1]):
            of.setdefault(h, []).append(i)
    names = {h: min((i for i in ids if i is not None), default=None) for h, ids in of.items()}
    pairs = {(names[a], names[b]): len(set(a) & set(b)) / len(a) for a in of for b in of if a != b and len(set(a) & set(b)) >= len(a) * at_least and set(a) & set(b)}
    return sorted(((i, names[h]) for h, ids in of.items() for i in ids), key=str), pairs


def test_containment_is_that_of_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    hot = " ".join(f"h{i}" for i in range(12))
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 40))), hot, *(word() for _ in range(rng.randint(0, 40)))])) for i in range(60)]
    rows += [(100 + i, " ".join(rows[i][1].split()[: 10 + i])) for i in range(30)] + [(200 + i, rows[i][1]) for i in range(10)]
    rows += [(300, hot), (301, None), (302, ""), (None, rows[3][1]), (303, " ".join(t for _, t in rows[:20])), (1, rows[1][1])]
    for scaled, at_least in ((1, 0.8), (1, 0.3), (4, 0.8), (4, 1.0)):
        s = fp.sketch(docs(spark, rows), 3, scaled).select("doc_id", "hashes", "scaled")
        of, want = brute_pairs(rows, 3, scaled, at_least)
        got = {(r.a, r.b): r.containment for r in fp.containment(s, at_least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert sorted(((r.doc_id, r.class_id) for r in fp.classes(s).collect()), key=str) == of
    assert fp.containment(fp.sketch(docs(spark, []))).collect() == [] and fp.classes(fp.sketch(docs(spark, []))).collect() == []


def test_hot_hashes_are_salted(spark):
    rows = [(i, "the same passage here " + " ".join(f"x{i}y{j}" for j in range(i % 3))) for i in range(2500)]
    s = fp.sketch(docs(spark, rows), 3, 1)
    got = Counter(r.a for r in fp.containment(s, 1.0).collect())
    of, _ = brute_pairs(rows[:30], 3, 1, 1.0)
    classes = len({c for _, c in brute_pairs(rows, 3, 1, 1.0)[0]})
    assert got == Counter({0: classes - 1})  # the passage alone is in every other class


def test_short_documents_in_long_ones_at_the_production_scale(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"v{rng.randrange(20000)}" for _ in range(n))
    rows, parts = [], {}
    for i in range(120):
        n = 50 + i
        part = text(n)
        rows += [(i, part), (1000 + i, f"{text(900)} {part} {text(900)}")]
        parts[i] = 1000 + i
    found = {(r.a, r.b) for r in fp.containment(fp.sketch(docs(spark, rows))).collect()}
    assert sum((a, b) in found for a, b in parts.items()) >= 0.93 * len(parts)
    assert all(parts.get(a) == b for a, b in found)


def test_merge(spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "c d e f z"), (3, None), (1, "q r s t"), (None, "m n o p"), (4, " ")]
    s = fp.sketch(docs(spark, rows), 3, 1)
    want = {}
    for i, t in rows:
        for h in brute(t, 3, 2)[1]:
            want.setdefault(i, set()).add(h)
    got = {}
    for r in fp.merge(s, "doc_id", scaled=2).collect():
        assert r.hash not in got.setdefault(r.doc_id, set()) and r.scaled == 2
        got[r.doc_id].add(r.hash)
    assert got == want
    whole = fp.merge(s, scaled=1).collect()
    assert sorted(r.hash for r in whole) == sorted({h for _, t in rows for h in brute(t, 3, 1)[1]})
    assert fp.merge(fp.sketch(docs(spark, [])), "doc_id").collect() == []
    with pytest.raises(Exception, match="can't be refined"):
        fp.merge(fp.sketch(docs(spark), 3, 4), scaled=2).collect()


def test_words_of_a_piece_at_a_time(spark, monkeypatch):
    """A batch of many documents is taken apart by pieces, so the words held at once don't grow with Spark's batches."""
    import numpy as np
    import pyarrow as pa

    from causerie.llm import fingerprints
    from causerie.shipping import PIECE_ROWS

    rows = [(k, f"a b c d e f {k} {k % 7} g h") for k in range(2 * PIECE_ROWS + 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {k: fingerprints.sketch(spark.createDataFrame([(k, t)], "doc_id bigint, text string")).first().hashes for k, t in rows[:: 4 * PIECE_ROWS // 5]}
    sizes = fingerprints.sketch(docs)
    got = {r.doc_id: r for r in sizes.collect()}
    assert len(got) == len(rows) and all(r.n_words == 10 for r in got.values()) and all(got[k].hashes == h for k, h in want.items())
    held = []
    monkeypatch.setattr(fingerprints, "Digests", lambda: None)
    monkeypatch.setattr(fingerprints, "shingle_hashes", lambda d, *_: held.append(len(d)) or (np.zeros(0, int),) * 2)

    class Docs:
        schema = docs.schema

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            list(f([pa.RecordBatch.from_pydict({"id": [k for k, _ in rows], "text": [t for _, t in rows]})]))
            return self

        def withColumnRenamed(self, *_):
            return self

    fingerprints.sketch(Docs())
    assert sum(held) == len(rows) and max(held) <= PIECE_ROWS
