"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.shipping import pieces, shared_dir, ship, written

__all__ = ["fresh", "n_tokens", "pieces", "shared_dir", "ship", "table", "written"]

#: Runs of anything but ASCII white space; the same characters in Java, RE2 and Python.
TOKEN_PATTERN = r"[^ \t\n\r\f\x0B]+"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_tokens(text: Column) -> Column:
    """Number of white-space separated tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
