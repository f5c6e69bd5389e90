"""Reading whole files and turning them into interchange documents."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.functions.text import newlines
from causerie.schema import DOC, DOC_ARROW
from causerie.shipping import pieces, ship


#: Bytes of files that a task reads, unless all cores would have less than TASKS each.
TASK_BYTES, TASKS = 32 << 20, 4


def find_files(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(path, length) of files in the order of their paths, without those in a folder named raw. Their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length").where(~F.col("path").contains("/raw/")).orderBy("path")


def whole_files(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(path, stem, content) of each file, newlines as LF, without those in a folder named raw.

    Spark opens a task for every few small files (a file counts as spark.sql.files.openCostInBytes at least); here tasks are as many as the bytes ask for.
    """
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    found = files.select(name.alias("path"), newlines(F.col("value")).alias("content")).coalesce(max(TASKS * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    return found.where(~F.col("path").contains("/raw/")).withColumn("stem", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", ""))


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files of a folder, UTF-8; names may have folders in them. A file gets its name when it is whole, so a task run twice does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        made = ""
        for b in (p for whole in batches for p in pieces(whole)):
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                to = f"{root}/{name}"
                if (parent := posixpath.dirname(to)) != made:
                    fs.create_dir(parent, recursive=True)
                    made = parent
                tmp = f"{to}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(tmp, compression=None) as out:
                    out.write((content or "").encode())
                if fs.get_file_info(to).type != pafs.FileType.NotFound:
                    fs.delete_file(to)
                fs.move(tmp, to)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    files.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def docs_by(df: DataFrame, f: Callable[..., dict | None], *columns: str) -> DataFrame:
    """Interchange documents, one a row of df for which f gives one, in Arrow batches. Only the named columns are sent to Python."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            made = (f(*row) for row in zip(*(b.column(c).to_pylist() for c in columns)))
            while part := list(islice((d for d in made if d is not None), 500)):
                yield pa.RecordBatch.from_pylist(part, schema=DOC_ARROW)

    return df.select(*columns).mapInArrow(run, DOC)


def document(doc_id: str, lang: str, domain: str, source: str, licence: str, text: str, replicas: list, characters: list, mentions: list) -> dict:
    return {"doc_id": doc_id, "lang": lang, "domain": domain, "source": source, "license": licence, "text": text, "replicas": replicas, "characters": characters, "mentions": mentions}


def replica(start: int, end: int, speaker: str | None = None, addressee: str | None = None, qtype: str | None = None, cue: tuple[int, int] | None = None, mode: str | None = None) -> dict:
    return {"start": start, "end": end, "speaker": speaker, "addressee": addressee, "qtype": qtype, "cue": cue and {"start": cue[0], "end": cue[1]}, "mode": mode}


def character(id_: str, name: str, aliases: list[str] = [], gender: str | None = None) -> dict:  # noqa: B006
    return {"id": id_, "name": name, "aliases": list(aliases), "gender": gender}


def gender(s: str) -> str | None:
    """m or f of male, female and their first letters, in any case."""
    return s[0].lower() if s.lower() in ("female", "f", "male", "m") else None


def collapsed(s: str) -> str:
    return " ".join(s.split())


class Ids:
    """Character ids by first use of a name."""

    def __init__(self) -> None:
        self.of: dict[str, str] = {}

    def get(self, name: str) -> str:
        return self.of.setdefault(name, f"char_{len(self.of)}")

    def characters(self) -> list[dict]:
        return [character(i, n) for n, i in self.of.items()]
