import math
import random

import numpy as np

from causerie.llm import language as lid

PIECES = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca"]


def brute(word, p):
    """Sum over all segmentations, by recursion."""
    ids = {x: i for i, x in enumerate(PIECES)}
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if (i := ids.get(word[:k])) is not None:
            total += p[i] * brute(word[k:], p)
        elif k == 1:
            total += math.prod(p[1 + b] for b in word[0].encode()) * brute(word[1:], p)
    return total


def test_forward_is_the_sum_over_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(PIECES)), 2).T
    lattice = lid.Lattice(PIECES)
    words = ["▁abcab", "▁", "▁xabéc", "▁cacaca", "▁bbbcabca"]
    f = lid.Forward(lattice, words)
    got = f.totals(f.arc_p(np.log(p)))
    for w, row in zip(words, got):
        assert np.allclose(np.exp(row), [brute(w, p[:, k]) for k in range(2)])


def test_expected_uses_are_those_of_all_segmentations():
    p = np.full((len(PIECES), 1), 1 / len(PIECES))
    f = lid.Forward(lid.Lattice(PIECES), ["▁ab"])
    uses = f.expected(f.arc_p(np.log(p)), np.array([3.0]), len(PIECES))
    q = 1 / len(PIECES)
    ways = {("▁", "a", "b"): q**3, ("▁", "ab"): q**2, ("▁a", "b"): q**2, ("▁ab",): q}
    for piece in ("▁", "a", "b", "ab", "▁a", "▁ab"):
        want = 3 * sum(v for k, v in ways.items() if piece in k) / sum(ways.values())
        assert abs(uses[PIECES.index(piece)] - want) < 1e-12


VOCAB = lid.VOCABULARY


def corpus(n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "and", "er", "wh", "ould", "th"], "de": ["sch", "ung", "der", "ein", "keit", "und", "über", "ch"], "es": ["ción", "que", "los", "ado", "mente", "ñ", "ar", "la"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 40))), lang) for i in range(n) for lang in [rng.choice(sorted(parts))]]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, language int, n_words int")


def test_held_out_accuracy_and_rejection(spark):
    model = lid.fit(lid.sample(docs(spark, corpus(600, 1)), rows=60), lid.vocabulary(VOCAB))
    test = corpus(300, 2)
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 -- !", "en"), (903, "qxzvkjw zzqpfgh xkcdqwz", "en"), (None, test[0][1], None), (904, "the " * 60000, "en"), (905, "漢字" * 400, "en")]
    rows = {(r.doc_id): r for r in lid.identify(docs(spark, test + odd), model).collect()}
    right = sum(rows[i].language == lang for i, _, lang in test)
    assert right >= 0.97 * len(test) and all(rows[i].accepted for i, _, lang in test)
    assert not any(rows[i].accepted for i in (900, 901, 902, 903)) and rows[None].accepted and rows[904].accepted
    # a script that no label is in: scored, and no language is likelier than none
    assert math.isfinite(rows[905].log_likelihood) and math.isfinite(rows[905].posterior) and rows[905].n_words == 1 and not rows[905].accepted
    assert rows[900].language is None and rows[902].n_words == 0
    kept = lid.keep_known(docs(spark, corpus(200, 1) + [(i, t, None) for i, t, _ in odd[:4]]))
    assert kept.columns == ["doc_id", "text", "lang", "language", "n_words"] and kept.count() == 200


def test_empty(spark):
    empty = docs(spark, [])
    model = lid.fit(lid.sample(empty), lid.vocabulary(VOCAB))
    assert lid.identify(empty, model).collect() == [] and lid.keep_known(empty).collect() == []
    unlabelled = docs(spark, [(1, "some text", None)])
    assert [r.accepted for r in lid.identify(unlabelled, lid.fit(lid.sample(unlabelled), lid.vocabulary(VOCAB))).collect()] == [False]
