"""The shared folder, and this package's code on executors that don't have it."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that Python takes apart at once.
PIECE_ROWS, PIECE_BYTES = 500, 4 << 20

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session, whose tasks all run here, gets a folder of its own, as in tests; on a cluster there is no folder that
    all executors are known to share, and the setting is asked for.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='causerie-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        _written.append((spark, named))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/causerie/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """b in parts of some PIECE_ROWS rows or PIECE_BYTES, so that Python objects are made of a part at a time, however large Spark's batches are."""
    rows = max(1, min(PIECE_ROWS, PIECE_BYTES * b.num_rows // max(1, b.nbytes)))
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def paths_so_far() -> int:
    return len(_written)


def replaced(df: DataFrame, name: str, since: int) -> DataFrame:
    """df written (see written); all that was written after since paths had been (see paths_so_far) is deleted then, as df alone read it."""
    out = written(df, name)
    for spark, path in _written[since:-1]:
        delete(spark, path)
    del _written[since:-1]
    return out


def ship(spark: SparkSession) -> None:
    """Give executors the package as a zip file, once an application; it is handed on by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("causerie", os.path.relpath(path, here)))
    path = new_path(spark, "code") + "/causerie_code.zip"
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


@atexit.register
def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)
