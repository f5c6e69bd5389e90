"""URL filters: a blocked Bloom filter, then an exact join of its possible hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.llm.common import table, written

SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
BLOCK_BYTES = 32
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
BAD_HOSTS = "(spam|pills|casino)"


def canonical_url(url: Column) -> Column:
    """One spelling for the addresses of one page; null for null and blank addresses.

    Without scheme, fragment, leading "www.", port 80 or 443, index page, slashes at the end and tracking parameters;
    the host in lower case; the other parameters sorted.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "(/index[.]html?)?/*$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole != "", whole)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its mask: one bit in each of the block's eight words."""
    u = h.astype(np.int64).view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bits = (low[:, None] * SALTS[None, :]) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bits


def build(hashes: DataFrame, n: int, max_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The filter (blocks x 8 words) of a column of 64-bit hashes h, of which there are n.

    16 bits a key, but never more than max_bytes: a longer list gets fewer bits a key, so more rows go on to
    the exact join, and the result stays the same. Blocks are put together by a bit_or aggregation.
    """
    blocks = int(max(1, min(-(-n * BITS_PER_KEY // (8 * BLOCK_BYTES)), max_bytes // BLOCK_BYTES)))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, mask = _places(b.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(mask[:, i].astype(np.int64)) for i in range(8))], ["block", *(f"w{i}" for i in range(8))])

    words = hashes.select("h").mapInArrow(masks, "block bigint, " + ", ".join(f"w{i} bigint" for i in range(8)))
    rows = words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    bloom = np.zeros((blocks, 8), np.uint32)
    at = rows.column("block").to_numpy()
    for i in range(8):
        bloom[at, i] = rows.column(f"w{i}").to_numpy().astype(np.uint32)
    return bloom


def might_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, mask = _places(h, len(bloom))
    return ((bloom[block] & mask) == mask).all(axis=1)


def flag_listed(pages: DataFrame, listed: DataFrame, url_col: str = "url", keys: tuple[str, ...] = ("page_id",), max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(keys, url, canonical_url, blocked) for every row of pages; blocked: its canonical address is that of an address in listed.

    listed has a column url, in any spelling, with nulls and repeats. Pages whose hash the filter doesn't
    hold pass without any join; only possible hits are shuffled, to the exact join on hash and address,
    which removes false positives. The filter is broadcast; its size has a bound (see build).

    Pages without an address, null or blank, are not blocked. Repeated pages are flagged one by one; ties don't arise. Very long addresses are compared whole. An empty list blocks
    nothing, an empty table of pages gives no rows. Columns besides keys and url are not read.
    """
    spark = pages.sparkSession
    names = listed.select(canonical_url(F.col("url")).alias("name")).where("name IS NOT NULL").distinct().select("name", F.xxhash64("name").alias("h"))
    names = written(names, "url-list")
    shared = spark.sparkContext.broadcast(build(names, names.count(), max_bytes))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(might_hold(shared.value, h.to_numpy()))

    slim = pages.select(*keys, F.col(url_col).alias("url"), canonical_url(F.col(url_col)).alias("canonical_url")).withColumn("h", F.xxhash64("canonical_url"))
    seen = written(slim.withColumn("hit", possible("h") & F.col("canonical_url").isNotNull()), "url-hits")
    out = [*keys, "url", "canonical_url"]
    passed = seen.where("NOT hit").select(*out, F.lit(False).alias("blocked"))
    hits = seen.where("hit").alias("p").join(names.alias("l"), (F.col("p.h") == F.col("l.h")) & (F.col("p.canonical_url") == F.col("l.name")), "left")
    return passed.unionByName(hits.select(*(F.col(f"p.{c}") for c in out), F.col("l.name").isNotNull().alias("blocked")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every address on a host with a bad word in its name."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.regexp_extract(canonical_url(F.col("url")), "^([^/?]*)", 1).rlike(BAD_HOSTS)).select("url")
    return flag_listed(pages, listed)


def _canonical_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}, ' '), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '(/index[.]html?)?/*$', '')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&')"
    return f"nullif({host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END, '')"


SQL = {
    "op3_url_filters": f"""
        WITH named AS (SELECT page_id, url, {_canonical_sql("url")} AS canonical_url FROM pages),
        listed AS (SELECT DISTINCT canonical_url AS name FROM named WHERE regexp_matches(regexp_extract(canonical_url, '^([^/?]*)', 1), '{BAD_HOSTS}'))
        SELECT page_id, url, canonical_url, (canonical_url IS NOT NULL AND canonical_url IN (SELECT name FROM listed)) AS blocked FROM named
    """
}
QUERIES = {"op3_url_filters": op3_url_filters}
