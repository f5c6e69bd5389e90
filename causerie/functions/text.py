"""Scalar expressions over names, texts and spans. Offsets are code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causerie.schema import NOBODY


def collapse(s: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def newlines(s: Column) -> Column:
    """CR LF and CR as LF."""
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_name(s: Column) -> Column:
    return F.translate(F.lower(collapse(s)), "ё", "е")


def canonical_actor(name: Column, aliases: Column) -> Column:
    """aliases: map of normalized alias to canonical name, or null."""
    n = normalize_name(name)
    return F.coalesce(F.try_element_at(aliases, n), n, F.lit(NOBODY))


def pred_actor_key(surface: Column, lemma: Column, aliases: Column) -> Column:
    """The alias of the surface form, else of the lemma, else the surface form; nobody for null and blank."""
    s, m = normalize_name(surface), normalize_name(lemma)
    known = F.coalesce(F.try_element_at(aliases, s), F.try_element_at(aliases, m), s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(NOBODY)).otherwise(known)


def split_of(doc_id: Column, heldout: float = 0.2) -> Column:
    """heldout if the first four bytes of the id's SHA-1, as a share of 2**32, are below the fraction; else tune."""
    share = F.conv(F.substring(F.sha1(F.encode(doc_id, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.when(share < heldout, F.lit("heldout")).otherwise(F.lit("tune"))


def ratio(n: Column, d: Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("      —")).otherwise(F.format_string("%6.1f%%", x * 100))


def find(text: Column, needle: Column, lo: Column, hi: Column) -> Column:
    """Offset of the first match that lies within [lo, hi); null if there is none."""
    at = F.call_function("locate", needle, F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0))))
    return F.when(at > 0, lo + at - 1)


def rfind(text: Column, needle: Column, lo: Column, hi: Column) -> Column:
    """Offset of the last match that lies within [lo, hi); null if there is none."""
    part = F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))
    at = F.call_function("locate", F.reverse(needle), F.reverse(part))
    return F.when(at > 0, lo + F.char_length(part) - at - F.char_length(needle) + 1)


def slice_(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def span_ok(start: Column, end: Column, size: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= size)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def merge_nested(into: dict, other: dict) -> dict:
    """other merged into into, which is changed and returned: maps within maps are merged, anything else is replaced."""
    for key, value in other.items():
        if isinstance(value, dict) and isinstance(into.get(key), dict):
            merge_nested(into[key], value)
        else:
            into[key] = value
    return into


def flat(text: Column) -> Column:
    """Line breaks as spaces, so that offsets stay."""
    return F.translate(text, "\n", " ")
