"""Small files in few tasks, and batches of which Python has a piece at a time."""

import pyarrow as pa

from causerie.operators import attribution, evaluation
from causerie.shipping import PIECE_BYTES, PIECE_ROWS, pieces
from causerie.sources.common import whole_files


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k}.txt").write_text(f"– {k}", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        files = whole_files(spark, str(tmp_path), "*.txt")
        assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted((r.stem, r.content) for r in files.collect()) == sorted((str(k), f"– {k}") for k in range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pieces_are_bounded_and_whole():
    short = pa.RecordBatch.from_pydict({"n": list(range(2 * PIECE_ROWS + 1))})
    assert [p.num_rows for p in pieces(short)] == [PIECE_ROWS, PIECE_ROWS, 1] and pa.Table.from_batches(pieces(short)).to_pydict() == short.to_pydict()
    long = pa.RecordBatch.from_pydict({"t": ["x" * (PIECE_BYTES // 2)] * 5 + [None]})
    assert max(p.nbytes for p in pieces(long)) <= PIECE_BYTES * 1.1 and sum(p.num_rows for p in pieces(long)) == 6
    assert list(pieces(short.slice(0, 0))) == []


def test_lines_and_links_of_more_than_a_piece(spark):
    n = 2 * PIECE_ROWS + 3
    docs = spark.createDataFrame([(str(k), f"– Да {k}.") for k in range(n)], "doc_id string, text string").coalesce(1)
    sizes = attribution.lines(docs).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n bigint")
    assert sum(r.n for r in sizes.collect()) == n
    said = [(str(k), 0, "a", f"x {k}") for k in range(n)]
    frame = spark.createDataFrame(said, "doc_id string, seq int, actor string, replica string")
    links = evaluation.align(frame, frame.where("doc_id <> '7'"), "doc_id").coalesce(1).collect()
    assert {r.doc_id: [tuple(x) for x in r.links] for r in links} == {str(k): [(0, 0)] if k != 7 else [] for k in range(n)}
