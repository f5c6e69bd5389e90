"""Words of letters that the vocabulary has as bytes only, of any length, and verdicts against brute force."""

import math
import random

import numpy as np
import pytest

from causerie.llm import language as lid
from tests.llm.test_language import PIECES, corpus, docs

BOLD, CHEROKEE, RUNE = chr(0x1D5EE), chr(0xAB70), chr(0x16A0)


@pytest.fixture(scope="module")
def model():
    texts = {}
    for _, text, lang in corpus(400, 1):
        texts.setdefault(lang, []).append(text)
    return lid.fit(texts, lid.vocabulary())


def log_sum(word, ids, log_p):
    """Log of the sum over all segmentations, letter by letter."""
    most, out = max(map(len, ids)), [0.0]
    for e in range(1, len(word) + 1):
        terms = [out[s] + log_p[ids[word[s:e]]] for s in range(max(0, e - most), e) if word[s:e] in ids]
        if word[e - 1] not in ids:
            terms.append(out[e - 1] + sum(log_p[ids[f"<0x{b:02X}>"]] for b in word[e - 1].encode()))
        top = max(terms)
        out.append(top + math.log(math.fsum(math.exp(t - top) for t in terms)))
    return out[-1]


def test_words_of_any_length_and_script(model):
    ids = {p: i for i, p in enumerate(model.pieces)}
    words = [letter * n for letter in (BOLD, CHEROKEE, RUNE, "e") for n in (1, 13, 31, 32, 33, 500)] + ["und", "漢字" * 15]
    got = lid.Scorer(model).words(words)
    assert np.isfinite(got).all()
    for w, row in zip(words, got):
        assert np.allclose(row, [log_sum(lid.SPACE + w, ids, model.log_p[:, k]) for k in range(got.shape[1])])


def test_long_clean_text_with_one_odd_word(spark, model):
    clean = " ".join(t for _, t, lang in corpus(400, 3) if lang == "de")
    rows = [(1, clean, None), (2, f"{clean} {BOLD * 20}", None), (3, f"{CHEROKEE * 20} {clean}", None), (4, f"{clean} {RUNE * 24} {'漢字' * 15}", None), (5, f"{clean} {RUNE * 5000}", None)]
    got = {r.doc_id: r for r in lid.identify(docs(spark, rows), model).collect()}
    assert len(got) == 5 and all(math.isfinite(r.log_likelihood) and math.isfinite(r.posterior) for r in got.values())
    assert all(got[i].language == "de" and got[i].accepted and got[i].posterior > 0.99 for i in (1, 2, 3, 4))


def test_identify_is_that_of_brute_force(spark):
    rng = random.Random(7)
    p = np.random.default_rng(3).dirichlet(np.ones(len(PIECES)), 2).T
    p = np.concatenate([p, np.full((len(PIECES), 1), 1 / len(PIECES))], axis=1)
    p[:, 1] = p[:, 0]  # two languages alike: a tie goes to the first by name
    third = np.random.default_rng(4).dirichlet(np.ones(len(PIECES)))
    log_p = np.log(np.column_stack([p[:, 0], p[:, 1], third, p[:, 2]]))
    m = lid.Model(["l1", "l2", "l3"], PIECES, log_p)
    texts = ["".join(rng.choice("abcé漢 ") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a" * 40, "漢" * 40, None, "", "1 2", "ab ab", "ab ab"]
    ids = {x: i for i, x in enumerate(PIECES)}
    got = {r.doc_id: r for r in lid.identify(docs(spark, list(zip(range(len(texts)), texts, [None] * len(texts)))), m, 0.45).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split() if t != "1 2" else []
        if not words:
            assert (got[i].language, got[i].posterior, got[i].log_likelihood, got[i].accepted) == (None, 0, None, False)
            continue
        total = [sum(log_sum(lid.SPACE + w, ids, log_p[:, k]) for w in words) for k in range(4)]
        best = 2 if total[2] > total[0] else 0
        posterior = 1 / sum(math.exp(min(x - total[best], 700)) for x in total)
        assert got[i].language == m.languages[best] and got[i].n_words == len(words)
        assert math.isclose(got[i].log_likelihood, total[best], rel_tol=1e-9) and math.isclose(got[i].posterior, posterior, rel_tol=1e-6)
        assert got[i].accepted == (posterior >= 0.45 and total[best] > total[3])


def test_columns_by_name_and_null_sources(spark):
    rows = [(i, t, lang, "x") for i, t, lang in corpus(60, 5)] + [(None, None, None, None), (1, "12", "en", None)]
    odd = spark.createDataFrame(rows, "key bigint, body string, label string, text string")
    kept = lid.keep_known(odd, id_col="key", text_col="body", lang_col="label")
    assert kept.columns == ["key", "body", "label", "text"] and kept.count() == 60
