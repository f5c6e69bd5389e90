"""Items of few and of many words in documents, against str.find."""

from causerie.operators import sequences


def test_locate(spark, monkeypatch):
    docs = [(1, "the cat sat on the mat"), (2, "a cat"), (3, None), (4, ""), (5, "thecat satonthemat cat sat"), (6, "мат cat 😀 the")]
    items = [(1, "cat"), (2, "cat sat"), (3, "sat on the"), (4, "the"), (5, "the"), (6, "no such"), (7, "😀 the"), (8, "cat sat on the mat"), (9, "at")]
    want = sorted((d, i, t.find(b)) for d, t in docs for i, b in items if t and b in t and (len(b.split()) < 3 or f" {' '.join(b.split()[1:-1])} " in t))
    frame = lambda rows, c: spark.createDataFrame(rows, c)
    for most in (sequences.AUTOMATON_CHARS, 5):
        monkeypatch.setattr(sequences, "AUTOMATON_CHARS", most)
        got = sequences.locate(frame(docs, "doc_id bigint, t string"), frame(items, "item_id bigint, b string"))
        assert sorted(tuple(r) for r in got.collect()) == want
    assert sequences.locate(frame(docs, "doc_id bigint, t string"), frame([], "item_id bigint, b string")).collect() == []
