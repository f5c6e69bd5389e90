"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causerie.llm import language, mixing, packing, simhash
from causerie.llm.common import ship, table
from causerie.shipping import paths_so_far, replaced


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages of docs' own labels; those without a word or in no language go.

    So null, empty and blank texts go, and all rows of a table without labels or rows. Very long texts are scored whole. Repeated rows stay or go together. Null ids and sources are kept; all columns pass by name.
    """
    ship(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, then of the least columns; null ids come last.

    Texts without a word are kept, each by itself, repeated ones too. Of repeated rows one is kept. An empty table stays empty. All columns pass by name.
    """
    ship(spark)
    return simhash.keep_one_each(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each source as many tokens as its weight, the square root of its tokens, gives it of the whole.

    A null source is a source. Rows of one id are in or out together. Null, empty and blank texts have no tokens. An empty table stays empty. All columns pass by name.
    """
    ship(spark)
    return mixing.keep_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 tokens: which tokens of which document go where.

    Null, empty and blank texts are in no bin, very long ones in several; repeated rows and null ids are packed each. An empty table gives no bins.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("mixing", mixing_weights), ("best-fit packing", best_fit_packing)]
#: The first and the last stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each keeps is written and read again, so that none is worked out twice.

    As soon as a stage's rows are written, those of the stage before and the stage's own intermediate tables are deleted: no more than two stages' texts lie in the shared folder at a time.
    """
    docs = table(spark, sf_dir, "documents")
    since = paths_so_far()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = replaced(docs, f"stage-{k}", since)
    return docs
