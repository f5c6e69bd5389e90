"""WARC: monolithic gzip files made into files of one gzip member a record, with an offset index beside them."""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.llm.common import table, written
from causerie.shipping import delete, new_path

CHUNK = 1 << 20
LEVEL = 6
#: A head of more bytes than this is an error: none grows without bound in memory.
MOST_HEAD = 64 << 20
INDEX = "path string, file string, record bigint, warc_type string, record_id string, target_uri string, offset bigint, length bigint, content_length bigint, error string"


class Inflated:
    """The plain bytes of a gzip stream, inflated once from start to end, a chunk at a time."""

    def __init__(self, source) -> None:
        self.source, self.inflate, self.have, self.raw = source, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        raw = self.raw or self.source.read(CHUNK)
        self.raw = b""
        if not raw:
            if not self.inflate.eof and self.started:
                raise ValueError("the gzip stream is cut off")
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.have += self.inflate.decompress(raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
        self.started = True
        return True

    started = False

    def line(self) -> bytes:
        at = 0
        while (end := self.have.find(b"\n", at)) < 0:
            at = len(self.have)
            if at > MOST_HEAD:
                raise ValueError("a line of the record's head doesn't end")
            if not self._more():
                end = len(self.have) - 1
                break
        out = bytes(self.have[: end + 1])
        del self.have[: end + 1]
        return out

    def parts(self, size: int) -> Iterator[bytes]:
        """The next size bytes, as they come."""
        while size:
            if not self.have and not self._more():
                raise ValueError("the record is cut off")
            out = bytes(self.have[:size])
            del self.have[: len(out)]
            size -= len(out)
            if out:
                yield out


def records(stream: Inflated) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """(head, fields, content length) of each record; the caller takes the content before the next one."""
    while True:
        first = stream.line()
        while first in (b"\r\n", b"\n"):
            first = stream.line()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head, fields, n = [first], {}, len(first)
        while (line := stream.line()).strip():
            head.append(line)
            n += len(line)
            if n > MOST_HEAD:
                raise ValueError("the record's head doesn't end")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not line:
            raise ValueError("the record's head is cut off")
        size = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size):
            raise ValueError(f"no record without a content length: {size[:40]!r}")
        yield b"".join(head) + b"\r\n", fields, int(size)


def _put(fs, tmp: str, to: str) -> None:
    """A finished file gets its name in one step: a task that is lost or run twice leaves a whole file or none."""
    if fs.get_file_info(to).type != pafs.FileType.NotFound:
        fs.delete_file(to)  # some file systems don't move onto a file
    fs.move(tmp, to)


#: How a field of the sidecar is written: one line a record, tabs between fields.
ESCAPES = str.maketrans({"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"})


def sidecar_line(fields: tuple) -> str:
    return "\t".join("-" if v is None else f"\\{v}" if v == "-" else str(v).translate(ESCAPES) for v in fields) + "\n"


def sidecar_fields(line: str) -> list[str | None]:
    """A line of the sidecar read back."""
    plain = {"t": "\t", "n": "\n", "r": "\r"}
    return [None if v == "-" else re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), v) for v in line.removesuffix("\n").split("\t")]


def output_name(path: str) -> str:
    """The file's own name after sixteen digits of its address's hash: files of one name in several folders don't meet."""
    return f"{sha256(path.encode()).hexdigest()[:16]}-{posixpath.basename(path)}"


def normalise_file(path: str, out_dir: str, attempt: str, level: int = LEVEL) -> Iterator[tuple]:
    """Rows of the index of one file; see normalise."""
    to_fs, to = pafs.FileSystem.from_uri(out_dir)
    name = output_name(path)
    to_fs.create_dir(to, recursive=True)
    tmp = f"{to}/.{name}.{attempt}"
    n, at, error = 0, 0, None
    try:
        fs, source = pafs.FileSystem.from_uri(path)
        raw = fs.open_input_stream(source, compression=None)
    except (OSError, ValueError) as e:
        yield (path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
        return
    with raw, to_fs.open_output_stream(tmp, compression=None) as out, to_fs.open_output_stream(f"{tmp}.idx", compression=None) as index:
        try:
            stream = Inflated(raw)
            for head, fields, size in records(stream):
                deflate, start = zlib.compressobj(level, zlib.DEFLATED, 31), at
                pieces = [deflate.compress(head)]
                for part in stream.parts(size):
                    pieces.append(deflate.compress(part))
                pieces += [deflate.compress(b"\r\n\r\n"), deflate.flush()]
                for piece in pieces:
                    out.write(piece)
                    at += len(piece)
                row = (n, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), start, at - start, size)
                index.write(sidecar_line(row).encode("utf-8", "surrogatepass"))
                yield (path, name, *row, None)
                n += 1
        except (OSError, ValueError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
    _put(to_fs, tmp, f"{to}/{name}")
    _put(to_fs, f"{tmp}.idx", f"{to}/{name}.idx")
    if error:
        yield (path, name, n, None, None, None, None, None, None, error)


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.taskAttemptId()}" if context else "0"


def normalise(files: DataFrame, out_dir: str, level: int = LEVEL) -> DataFrame:
    """The index, (path, file, record, warc_type, record_id, target_uri, offset, length, content_length, error), of gzip WARC files whose addresses are in files' column path.

    Each file is inflated once, as a stream, and written to out_dir as file (see output_name: unlike for unlike addresses) with every record as a gzip member of its own: length bytes from offset
    on inflate to the record alone. Beside it FILE.idx has a line a record: record, type, id, target, offset, length, content length, with tabs between them, "-" for what is missing, and tabs, line ends and
    backslashes escaped (see sidecar_fields).

    A file that is cut off or holds anything else, a record without a content length or with an endless head among it, gives the records up to there and a row with error; a file that can't be opened gives such a row
    alone, with null file. An empty file has no records, an empty table no rows. Null paths are left out; of repeated paths one
    is taken. Records of any length pass in pieces; repeated records are records of their own. Other columns are not read. One task a file; a task holds one compressed record. Run again, a task writes the same files.
    """
    paths = files.select("path").where("path IS NOT NULL").distinct()
    # dealt from one partition, of paths alone, each task gets just one
    paths = paths.coalesce(1).repartition(max(1, paths.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        rows = (r for b in batches for path in b.column("path").to_pylist() for r in normalise_file(path, out_dir, _attempt(), level))
        while part := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    return paths.mapInArrow(run, INDEX)


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record, head and content, by way of the index."""
    fs, where = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(where) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def write_monolithic(pages: DataFrame, out_dir: str) -> DataFrame:
    """(path): pages as WARC files of one gzip stream each, a file a partition of pages. Null html is empty; a null address is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, to = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(to, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        tmp = f"{to}/.{name}.{_attempt()}"
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        with fs.open_output_stream(tmp, compression=None) as out:
            for b in batches:
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    body = (html or "").encode()
                    target = f"WARC-Target-URI: {url}\r\n" if url is not None else ""
                    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\n{target}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
                    out.write(deflate.compress(head.encode() + body + b"\r\n\r\n"))
            out.write(deflate.flush())
        _put(fs, tmp, f"{to}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{name}"])], ["path"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string")


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are first written as monolithic files, which are deleted when they have been normalised. file: the monolithic file's name."""
    staged, out = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    files = written(write_monolithic(table(spark, sf_dir, "pages"), staged), "warc-paths")
    index = written(normalise(files, out), "warc-index")
    delete(spark, staged)
    page = F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return index.drop("path").withColumn("file", F.expr("substring(file, 18)")).withColumn("page_id", page)


SQL: dict[str, str] = {}
QUERIES = {"op6_warc_normaliser": op6_warc_normaliser}
