"""Readers by the name of their source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causerie.sources import markup, native, standoff

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "native": native.convert,
    "rusdracor": markup.tei,
    "quoteli3": markup.quotes,
    "droc": markup.xmi,
    "pdnc": standoff.novels,
    "riqua": standoff.brat,
    "jy_quoteplus": standoff.quote_arrays,
}


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in READERS:
        raise KeyError(f"no source {name!r}; there are {sorted(READERS)}")
    return READERS[name]
