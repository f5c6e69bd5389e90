import json
import os

from causerie.operators import attribution
from causerie.streaming import live


def test_stream_is_as_batch(spark, tmp_path):
    texts = {"a": "– Пойдём, – сказала Марта.\n– Нет, – ответил Яков.\n– Да!", "b": "– Кто?"}
    (tmp_path / "in").mkdir()
    for k, t in texts.items():
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"doc_id": k, "text": t}, ensure_ascii=False), encoding="utf-8")
    live.start(live.lines(live.read_documents(spark, str(tmp_path / "in"))), f"lines{id(texts)}", path=str(tmp_path / "out")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(tuple(r.values()) for k, t in texts.items() for r in attribution.rows_of(k, t))


def test_turns_out_of_order(spark, tmp_path):
    rows = [("d", 1, "b", "Яков"), ("d", 0, "a", "Марта"), ("d", 3, "d", None), ("d", 2, "c", None), ("d", 5, "f", None), ("e", 0, "x", None), ("d", 1, "again", "x")]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "seq", "text", "speaker"), r)) | {"at": f"2026-01-01 00:0{i}:00"}) for r in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    turns = spark.readStream.schema(live.TURNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live.start(live.live_lines(turns), f"turns{id(rows)}", path=str(tmp_path / "out")).awaitTermination(120)
    got = sorted((r.doc_id, r.seq, r.text, r.actor) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("d", 0, "a", "Марта"), ("d", 1, "b", "Яков"), ("d", 2, "c", "Марта"), ("d", 3, "d", "Яков"), ("e", 0, "x", None)]
