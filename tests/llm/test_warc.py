import gzip
import zlib

from causerie.llm import warc

PAGES = [(1, "http://a.com/ä", "<html>ü</html>"), (2, None, ""), (None, "http://b.com", None), (1, "http://a.com/ä", "<html>ü</html>"), (3, "http://c.com", "x" * 3_000_000 + "\r\n\r\nWARC/1.0\r\n"), (4, "http://d.com/a\tb\\t-", "tab"), (5, "-", "a dash")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, path string").repartition(2)


def parse(plain):
    """(type, id, target, content) of the records of a plain WARC file, from its end of heads and content lengths alone."""
    out, at = [], 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        version, *lines = plain[at:end].decode().split("\r\n")
        assert version == "WARC/1.0"
        fields = dict(line.split(": ", 1) for line in lines)
        body = plain[end + 4 : end + 4 + int(fields["Content-Length"])]
        out.append((fields.get("WARC-Type"), fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), body))
        at = end + 4 + len(body) + 4
    return out


def test_every_column_is_that_of_a_plain_parser(spark, tmp_path):
    mono, out = f"file://{tmp_path}/mono", f"file://{tmp_path}/out"
    files = warc.write_monolithic(pages(spark), mono)
    files.cache()
    rows = warc.normalise(files, out).collect()
    assert len(rows) == len(PAGES) and not any(r.error for r in rows) and {r.path for r in rows} == {r.path for r in files.collect()}
    for path in {r.path for r in rows}:
        mine = sorted((r for r in rows if r.path == path), key=lambda r: r.offset)
        name = warc.output_name(path)
        assert {r.file for r in mine} == {name} and [r.record for r in mine] == list(range(len(mine)))
        whole = (tmp_path / "out" / name).read_bytes()
        plain = gzip.decompress((tmp_path / "mono" / path.rsplit("/", 1)[1]).read_bytes())
        assert gzip.decompress(whole) == plain
        want = parse(plain)
        assert [(r.warc_type, r.record_id, r.target_uri, r.content_length) for r in mine] == [(t, i, u, len(body)) for t, i, u, body in want]
        assert [r.offset for r in mine] + [len(whole)] == [0] + [r.offset + r.length for r in mine]
        index = [warc.sidecar_fields(line) for line in (tmp_path / "out" / f"{name}.idx").read_text().splitlines(True)]
        assert index == [[str(r.record), r.warc_type, r.record_id, r.target_uri, str(r.offset), str(r.length), str(r.content_length)] for r in mine]
        for r, w in zip(mine, want):
            assert parse(warc.read_record(f"{out}/{name}", r.offset, r.length)) == [w]
            again = zlib.decompressobj(31)
            again.decompress(whole[r.offset : r.offset + r.length])
            assert again.eof and not again.unused_data


def test_sidecar_round_trip():
    fields = (1, None, "-", "a\tb\r\nc\\t", "\\", "", "--")
    assert warc.sidecar_fields(warc.sidecar_line(fields)) == ["1", None, "-", "a\tb\r\nc\\t", "\\", "", "--"]
    assert warc.sidecar_line(fields).count("\t") == len(fields) - 1


def record(content, length=None):
    return b"WARC/1.0\r\n" + (f"Content-Length: {len(content) if length is None else length}\r\n" if length != "" else "").encode() + b"\r\n" + content + b"\r\n\r\n"


def test_files_of_one_name(spark, tmp_path):
    for folder, content in (("a", b"first"), ("b", b"the second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.warc.gz").write_bytes(gzip.compress(record(content)))
    paths = [(f"file://{tmp_path}/{x}/f.warc.gz",) for x in "ab"]
    out = f"file://{tmp_path}/out"
    rows = warc.normalise(spark.createDataFrame(paths, "path string"), out).collect()
    assert len({r.file for r in rows}) == 2 and all(r.file.endswith("-f.warc.gz") for r in rows)
    got = {r.path[-11]: warc.read_record(f"{out}/{r.file}", r.offset, r.length) for r in rows}
    assert got == {"a": record(b"first"), "b": record(b"the second")}


def test_broken_missing_and_empty_files(spark, tmp_path, monkeypatch):
    whole = gzip.compress(record(b"abc") + record(b"defg"))
    bad = {"cut": whole[:-12], "none": b"", "other": gzip.compress(b"no such thing"), "plain": b"WARC/1.0\r\n", "two": whole + whole}
    bad |= {"unsized": gzip.compress(record(b"abc") + record(b"x", "")), "negative": gzip.compress(record(b"abc", -5)), "short": gzip.compress(record(b"abc", 99)), "endless": gzip.compress(record(b"abc") + b"WARC/1.0\r\nX: " + b"y" * 5_000_000)}
    for name, data in bad.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    paths = [(f"file://{tmp_path}/{n}.warc.gz",) for n in (*bad, "two", "missing")] + [(None,), ("nosuch://x/y.warc.gz",)]
    rows = warc.normalise(spark.createDataFrame(paths, "path string"), f"file://{tmp_path}/out").collect()
    count = {}
    for r in rows:
        count.setdefault(r.path.rsplit("/", 1)[1].split(".")[0], []).append(bool(r.error))
    assert sorted(count.pop("two")) == [False] * 4 and count.pop("cut")[-1]
    assert count == {"other": [True], "plain": [True], "unsized": [False, True], "negative": [True], "short": [True], "endless": [False, True], "missing": [True], "y": [True]}
    assert {r.file is None for r in rows if r.path.endswith("missing.warc.gz")} == {True}
    monkeypatch.setattr(warc, "MOST_HEAD", 2_000_000)
    ended = list(warc.normalise_file(f"file://{tmp_path}/endless.warc.gz", f"file://{tmp_path}/out2", "0"))
    assert len(ended) == 2 and "doesn't end" in ended[1][-1]


def test_one_file_a_task_and_no_files(spark, tmp_path):
    assert warc.normalise(spark.createDataFrame([], "path string"), f"file://{tmp_path}/out").collect() == []
    many = spark.createDataFrame([(f"p{i}",) for i in range(23)], "path string").distinct()
    sizes = many.coalesce(1).repartition(23).rdd.glom().map(len).collect()
    assert sizes == [1] * 23
    none = warc.write_monolithic(pages(spark, []), f"file://{tmp_path}/no")
    assert not any(r.error for r in warc.normalise(none, f"file://{tmp_path}/out").collect())
