"""Alignment of conversations that say the same thing more than once, against difflib."""

from collections import Counter
from difflib import SequenceMatcher

from causerie import catalogue

TURNS = {1: ["yes", "no", "yes", "yes", " yes\n", "", "no", "so it is"], 2: ["ok"] * 6, 3: ["a", "b", "c", "b", "a"], 4: ["x", "y", "x", "x", "z", "y", "x", "x"]}


def expected():
    counted, wrong, kinds = [], [], {k: Counter() for k in ("explicit", "anaphoric", "implicit")}
    for conv, texts in TURNS.items():
        gold = [(k, "user" if k % 2 == 0 else "assistant", " ".join(t.split())) for k, t in enumerate(texts) if t.strip()]
        pred = [(k, "somebody" if k == 3 else who, t) for k, who, t in gold if k != 2]
        blocks = SequenceMatcher(None, [t for *_, t in gold], [t for *_, t in pred], autojunk=False).get_matching_blocks()
        links = {b.a + i: b.b + i for b in blocks for i in range(b.size)}
        same = {g: gold[g][1] == pred[p][1] for g, p in links.items()}
        counted.append((conv, len(gold), len(pred), len(links), sum(same.values())))
        wrong += [(conv, gold[g][0], gold[g][1], pred[p][1]) for g, p in links.items() if not same[g]]
        for g, (k, *_) in enumerate(gold):
            kinds[("explicit", "anaphoric", "implicit")[k % 3]] += Counter(n_gold=1, n_matched=int(g in links), n_correct=int(same.get(g, False)))
    return counted, sorted(wrong), {k: tuple(c[n] for n in ("n_gold", "n_matched", "n_correct")) for k, c in kinds.items()}


def test_repeated_turns_are_aligned_as_difflib_does(spark, tmp_path):
    rows = [(conv, k, "user" if k % 2 == 0 else "assistant", t) for conv, texts in TURNS.items() for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    counted, wrong, kinds = expected()
    assert sorted(tuple(r) for r in catalogue.align_blocks(spark, str(tmp_path)).collect()) == counted
    assert sorted(tuple(r) for r in catalogue.attribution_errors(spark, str(tmp_path)).collect()) == wrong and wrong
    assert {r.qtype: (r.n_gold, r.n_matched, r.n_correct) for r in catalogue.eval_by_qtype(spark, str(tmp_path)).collect()} == kinds
