import json
import os

from causerie.streaming import live


def test_turns_behind_a_lost_one_are_given_out(spark, tmp_path):
    parts = [[("d", 0, "a", "Anna", "00:00"), ("d", 2, "c", "Boris", "00:00"), ("d", 3, "e", "Vera", "00:00"), ("d", 4, "f", None, "00:01"), ("d", 6, "g", None, "00:01")], [("e", 0, "x", None, "05:00")], [("e", 1, "y", None, "05:01")], [("d", 7, "h", "Anna", "05:02")], [("e", 2, "z", None, "09:00")], [("e", 3, "w", None, "09:01")]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"doc_id": d, "seq": n, "text": t, "speaker": s, "at": f"2026-01-01 {at}:00"}) for d, n, t, s, at in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    turns = spark.readStream.schema(live.TURNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live.start(live.live_lines(turns), f"gap{id(parts)}", path=str(tmp_path / "out")).awaitTermination(120)
    got = sorted((r.seq, r.text, r.actor, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).where("doc_id = 'd'").collect())
    assert got == [(0, "a", "Anna", "given"), (2, "c", "Boris", "after_gap"), (3, "e", "Vera", "after_gap"), (4, "f", "Boris", "after_gap"), (6, "g", None, "after_gap"), (7, "h", "Anna", "after_gap")]
