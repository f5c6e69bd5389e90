"""Sharding: contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.llm.common import shared_dir, table

NUM_SHARDS = 64


def shard(docs: DataFrame, num_shards: int = NUM_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, start_byte, shard) for every row of docs.

    The corpus is laid out in the order of id (null first, then by size). start_byte is the number of
    UTF-8 bytes before the row. Shard k holds the rows that start in [k * target, (k + 1) * target) with
    target = ceil(total / num_shards): shards are contiguous, and each is within the size of its last
    row of the target.

    Only (id, n_bytes) is range-partitioned and sorted, not the text. Bytes are summed within each
    partition; the totals (one number a partition) are summed up on the driver and handed back as offsets,
    so no window runs over the whole corpus in one task.

    Null text counts as 0 bytes; rows of 0 bytes go where they start, those at the very end to the last
    shard. Repeated ids keep all their rows. A text longer than the target is a row of its shard like others, and the shards that it covers besides are empty. An empty table gives no rows. Other columns are not read.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    spark = docs.sparkSession
    shared_dir(spark)
    order = [F.col("id").asc_nulls_first(), F.col("n_bytes").asc()]
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = slim.schema["id"].dataType.simpleString()
    # checkpoint() keeps the partitions and their order, which a written table would not
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = sorted((r["part"], r["total"]) for r in ordered.groupBy("part").agg(F.sum("n_bytes").alias("total")).collect())
    offsets, total = {}, 0
    for part, size in totals:
        offsets[part] = total
        total += size
    target = max(1, -(-total // num_shards))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, 0
        for b in batches:
            parts, sizes = b.column("part").to_numpy(), b.column("n_bytes").to_numpy()
            starts = np.empty(len(sizes), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if at != parts[lo]:
                    at, running = parts[lo], offsets[int(parts[lo])]
                ends = running + np.cumsum(sizes[lo:hi])
                starts[lo:hi] = ends - sizes[lo:hi]
                running = int(ends[-1])
            shards = np.minimum(starts // target, num_shards - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(starts), pa.array(shards)], ["id", "n_bytes", "start_byte", "shard"])

    out = ordered.mapInArrow(prefix, f"id {kind}, n_bytes bigint, start_byte bigint, shard int")
    return out.withColumnRenamed("id", id_col)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = {
    "op4_sharding": f"""
        WITH sized AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
        placed AS (
            SELECT doc_id, n_bytes,
                   CAST(coalesce(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
            FROM sized),
        target AS (SELECT greatest(1, CAST((sum(n_bytes) + {NUM_SHARDS - 1}) // {NUM_SHARDS} AS BIGINT)) AS t FROM sized)
        SELECT doc_id, n_bytes, start_byte, CAST(least(start_byte // t, {NUM_SHARDS - 1}) AS INTEGER) AS shard FROM placed, target
    """
}
QUERIES = {"op4_sharding": op4_sharding}
