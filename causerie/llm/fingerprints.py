"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.llm.common import pieces, table, written
from causerie.llm.words import Digests

SHINGLE = 5
#: One hash in so many is kept: the production scale, fit for texts from some 50 words on.
SCALED = 8
#: Share of a document's kept hashes that another must have in the query of containment.
CONTAINED = 0.8


#: Modulus and multipliers of the two halves of a shingle's hash; see shingle_hashes.
PRIME = (1 << 31) - 1
MULTIPLIERS = ((1103515245, 1812433253 % PRIME, 69069, 1566083941, 1664525, 22695477, 1140671485, 214013), (742938285, 950706376, 1226874159, 62089911, 1343714438, 630360016, 16807, 48271))
BATCH_WORDS = 200_000


def limit(scaled: int) -> int:
    """The hashes kept are those below this."""
    if scaled < 1:
        raise ValueError("scaled must be at least 1")
    return -(-(PRIME << 31) // scaled)


def shingle_hashes(docs: list[list[bytes]], known: Digests, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and 62-bit hash of every shingle of docs (lists of words).

    A word's MD5 gives two numbers, its first and second four bytes modulo 2**31 - 1. A half of a shingle's hash is the
    sum of its words' numbers, each times the multiplier of its place, modulo 2**31 - 1; the first half is the high one.
    A document of fewer words is one shingle.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    words = known.indices(docs, int(sizes.sum()))
    # each document is followed by places that count for nothing, so that no shingle reaches into the next one
    pad = shingle - 1
    first = np.concatenate([[0], np.cumsum(sizes + pad)])
    owner = np.repeat(np.arange(len(docs)), sizes + pad)
    place = np.arange(first[-1]) - first[owner]
    real = place < sizes[owner]
    starts = np.flatnonzero((place <= np.maximum(sizes[owner] - shingle, 0)) & (sizes[owner] > 0))
    digits = known.rows.view(">u4")
    value = np.zeros(len(starts), np.int64)
    for half in range(2):
        numbers = np.zeros(first[-1], np.int64)
        numbers[real] = (digits[:, half].astype(np.int64) % PRIME)[words]
        total = np.zeros(len(starts), np.int64)
        for k in range(shingle):
            total += (numbers * MULTIPLIERS[half][k] % PRIME)[starts + k]
        value = (value << 31) + total % PRIME
    return owner[starts], value


def sketch(docs: DataFrame, shingle: int = SHINGLE, scaled: int = SCALED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, scaled, hashes) for every row of docs; hashes: the distinct hashes below 1/scaled of the range, sorted.

    Words are the runs of anything but ASCII white space of the lower-case text. Whether a hash is kept depends on
    the hash alone, so sketches of one scale are subsets of the same sample of all
    shingles: they merge by union, and the share of A's kept hashes that B keeps estimates how much of A is
    in B without bias, however unequal A and B are.

    No shuffle: one pass over the text, in Arrow batches; an MD5 a distinct word instead of one a shingle. A text of fewer words than a shingle is one shingle. Null and blank texts have 0
    words and no hashes. Very long texts are sketched whole. Ids may repeat or be null: each row, repeated ones too, has its own sketch. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= shingle <= len(MULTIPLIERS[0]):
        raise ValueError(f"shingle must be from 1 to {len(MULTIPLIERS[0])}")
    top = limit(scaled)
    kind = docs.schema[id_col].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Digests()
        for b in (p for whole in batches for p in pieces(whole)):
            words = [t.lower().encode("utf-8", "surrogatepass").split() if t else [] for t in b.column("text").to_pylist()]
            lo = 0
            while lo < len(words):  # by so many words at a time, or one long document
                hi, n = lo + 1, len(words[lo])
                while hi < len(words) and n + len(words[hi]) <= BATCH_WORDS:
                    n += len(words[hi])
                    hi += 1
                owner, value = shingle_hashes(words[lo:hi], known, shingle)
                few = value < top
                owner, value = owner[few], value[few]
                order = np.lexsort((value, owner))
                owner, value = owner[order], value[order]
                once = np.ones(len(value), bool)
                once[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
                owner, value = owner[once], value[once]
                offsets = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                sizes = pa.array([len(w) for w in words[lo:hi]], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), sizes, pa.array(np.full(hi - lo, scaled, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(value))], ["id", "n_words", "scaled", "hashes"])
                lo = hi

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(sketches, f"id {kind}, n_words int, scaled int, hashes array<bigint>").withColumnRenamed("id", id_col)


def merge(sketches: DataFrame, *keys: str, scaled: int = SCALED) -> DataFrame:
    """(keys, scaled, hash): a row a hash of the sketch of the union of each group's documents, at one scale for all.

    A sketch of a finer scale holds that of a coarser one: of it the hashes below 1/scaled of the range count. One that is coarser than scaled can't be refined and fails the job.
    A row a hash, so that no group, however large, is gathered; hashes are made distinct within partitions before they are shuffled, by (keys, hash).

    Null keys are keys like others; without keys all documents are one group. Null and blank texts add nothing, so a group of them alone has no rows; repeated documents add nothing. An empty table gives no rows.
    """
    top = limit(scaled)
    kept = F.when(F.col("scaled") > scaled, F.raise_error(F.format_string("a sketch of scale %d can't be refined", "scaled")).cast("array<bigint>")).otherwise(F.filter("hashes", lambda h: h < top))
    return sketches.select(*keys, F.lit(scaled).alias("scaled"), F.explode(kept).alias("hash")).distinct()


def classes(sketches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, class_id) of every row whose sketch has a hash: rows with one and the same set of hashes are a class, named by its least id (null only if all are null)."""
    named = sketches.where(F.size("hashes") > 0).select(F.col(id_col).alias("id"), _name(F.col("hashes")).alias("n"))
    least = named.groupBy("n").agg(F.min("id").alias("class_id"))
    return named.join(least, "n").select(F.col("id").alias(id_col), "class_id")


def _name(hashes: Column) -> Column:
    """128 bits that tell sets of hashes apart."""
    return F.md5(F.to_binary(F.array_join(hashes, ","), F.lit("utf-8")))


def containment(sketches: DataFrame, at_least: float = CONTAINED, id_col: str = "doc_id") -> DataFrame:
    """(a, b, shared, containment): estimated share of a's shingles that b has, for all ordered pairs of classes (see classes) that share a hash and of which it is at_least.

    Rows with equal sketches are one class, so copies are not paired with each other. Who has at_least of a's n hashes has one of any n - ceil(at_least n) + 1 of them: a is looked up
    by so many of its rarest ones alone, and hashes that many documents share are used only for documents that hardly have others. Where they are, they are dealt out by salt: the rows of b with a hash go to as many places as
    they are thousands, to each of which a's go. Candidates are verified on whole sketches. All sketches must be of one scale.

    Ids should be unique for other uses, but may be null or repeat. Documents without kept hashes are in no class and no pair: at scale 1 in s a text of n shingles
    has none with probability (1 - 1/s)^n. Ties don't arise. An empty table gives no rows.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be above 0 and at most 1")
    some = sketches.where(F.size("hashes") > 0).select(F.col(id_col).alias("id"), "hashes")
    one = written(some.groupBy(_name(F.col("hashes")).alias("name")).agg(F.min("id").alias("id"), F.first("hashes").alias("hashes")), "sketch-classes")
    each = one.select("name", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    common = written(each.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"), "sketch-common")
    shared = written(each.join(common, "hash"), "sketch-shared")
    # hashes of one document are those of no other: they come first and pair with nobody
    alone = F.col("n") - F.count("*").over(Window.partitionBy("name"))
    rank = alone + F.row_number().over(Window.partitionBy("name").orderBy("df", "hash"))
    looked_up = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least)) + 1)
    places = F.greatest(F.lit(1), F.ceil(F.col("df") / 1000)).cast("int")
    a = looked_up.select(F.col("name").alias("a"), "hash", F.explode(F.sequence(F.lit(0), places - 1)).alias("salt"))
    b = shared.select(F.col("name").alias("b"), "hash", F.pmod(F.xxhash64("name"), places.cast("bigint")).cast("int").alias("salt"))
    pairs = written(a.join(b, ["hash", "salt"]).where("a <> b").select("a", "b").distinct(), "sketch-candidates")
    left, right = one.select(F.col("name").alias("a"), F.col("id").alias("a_id"), F.col("hashes").alias("a_hashes")), one.select(F.col("name").alias("b"), F.col("id").alias("b_id"), F.col("hashes").alias("b_hashes"))
    counted = pairs.join(left, "a").join(right, "b").select("a_id", "b_id", F.size(F.array_intersect("a_hashes", "b_hashes")).alias("shared"), F.size("a_hashes").alias("n"))
    return counted.where(F.col("shared") >= F.col("n") * F.lit(at_least)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "shared", (F.col("shared") / F.col("n")).alias("containment"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch(table(spark, sf_dir, "documents"))


def fingerprint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of whole sources, at a coarser scale."""
    docs = table(spark, sf_dir, "documents")
    sketched = sketch(docs.withColumn("key", F.struct("doc_id", "source")), id_col="key")
    return merge(sketched.select(F.col("key.source").alias("source"), "scaled", "hashes"), "source", scaled=8 * SCALED).groupBy("source").agg(F.count("*").alias("n_hashes"), F.min("hash").alias("least"), F.sum(F.col("hash") % 1_000_003).alias("checksum"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(sketch(table(spark, sf_dir, "documents")))


def fingerprint_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment(sketch(table(spark, sf_dir, "documents")))


def _half_sql(half: int) -> str:
    terms = (f"coalesce(CAST('0x' || substr(md5(words[i + {k}]), {1 + 8 * half}, 8) AS BIGINT) % {PRIME} * {MULTIPLIERS[half][k]} % {PRIME}, 0)" for k in range(SHINGLE))
    return f"(({' + '.join(terms)}) % {PRIME})"


_SKETCHED = f"""
    split AS (
        SELECT doc_id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS words FROM documents),
    hashed AS (
        SELECT doc_id, source, CAST(len(words) AS INTEGER) AS n_words,
               list_transform(CASE WHEN len(words) > 0 THEN range(1, greatest(len(words) - {SHINGLE - 2}, 2)) ELSE [] END,
                              lambda i: CAST({_half_sql(0)} AS BIGINT) * {1 << 31} + {_half_sql(1)}) AS hashes
        FROM split),
    sketched AS (SELECT doc_id, source, n_words, {SCALED} AS scaled, list_sort(list_distinct(list_filter(hashes, lambda h: h < {limit(SCALED)}))) AS hashes FROM hashed)"""
SQL = {
    "op1_document_fingerprints": f"WITH {_SKETCHED} SELECT doc_id, n_words, scaled, hashes FROM sketched",
    "fingerprint_merge": f"""
        WITH {_SKETCHED}, each AS (SELECT DISTINCT source, unnest(hashes) AS hash FROM sketched)
        SELECT source, count(*) AS n_hashes, min(hash) AS least, CAST(sum(hash % 1000003) AS BIGINT) AS checksum FROM each WHERE hash < {limit(8 * SCALED)} GROUP BY source""",
    "fingerprint_classes": f"WITH {_SKETCHED} SELECT doc_id, min(doc_id) OVER (PARTITION BY hashes) AS class_id FROM sketched WHERE len(hashes) > 0",
    "fingerprint_containment": f"""
        WITH {_SKETCHED}, one AS (SELECT min(doc_id) AS id, hashes FROM sketched WHERE len(hashes) > 0 GROUP BY hashes),
        each AS (SELECT id, len(hashes) AS n, unnest(hashes) AS hash FROM one),
        counted AS (SELECT a.id AS a, b.id AS b, a.n, count(*) AS s FROM each a JOIN each b ON a.hash = b.hash AND a.id <> b.id GROUP BY 1, 2, 3)
        SELECT a, b, CAST(s AS INTEGER) AS shared, s::DOUBLE / n AS containment FROM counted WHERE s >= n * {CONTAINED}::DOUBLE""",
}
QUERIES = {"op1_document_fingerprints": op1_document_fingerprints, "fingerprint_merge": fingerprint_merge, "fingerprint_classes": fingerprint_classes, "fingerprint_containment": fingerprint_containment}
