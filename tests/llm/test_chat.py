from causerie.llm import chat

ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello 😀"), (1, 2, None, None), (1, 3, "assistant", None), (2, 0, "assistant", "first"), (None, 5, "assistant", "x"), (3, 1, "user", "only"), (1, 3, "assistant", None)]


def convs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, at string")


def test_expansion(spark):
    rows = chat.expand_turns(convs(spark)).collect()
    got = sorted((str(r.conv_id), r.turn, r.n_context, r.text[r.loss_start : r.loss_end]) for r in rows)
    assert got == [("1", 1, 1, "hello 😀<|end|>\n"), ("1", 3, 3, "<|end|>\n"), ("1", 3, 4, "<|end|>\n"), ("2", 0, 0, "first<|end|>\n"), ("None", 5, 0, "x<|end|>\n")]
    long = next(r for r in rows if r.n_context == 3)
    assert long.text == "<|user|>\nhi<|end|>\n<|assistant|>\nhello 😀<|end|>\n<|unknown|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.expand_turns(convs(spark, [])).collect() == []
