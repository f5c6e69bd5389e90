"""Annotated texts: text, a line of dashes, "actor::replica" lines, and perhaps a line of dashes and "name = alias | alias" lines."""

from __future__ import annotations

import json
import re
import warnings
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.functions.text import canonical_actor, newlines, normalize_name, strip
from causerie.schema import NOBODY
from causerie.sources.common import character, collapsed, docs_by, document, replica, whole_files

DASHES = "-" * 20
E_FOR_YO = {ord("ё"): "е"}
SPACES, WIDE = re.compile(r"\s+"), re.compile(r"\s{2,}")


def sections(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text, pairs array<struct<actor,replica>>, aliases map<string,string> and error (null if the file is in order).

    All in Spark's own functions. A later alias replaces an earlier one.
    """
    parts = F.split(newlines(F.col(content)), "-{20}", -1)
    full = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), "\n", -1), lambda s: strip(s) != "")
    df = files.withColumn("_p", parts)
    said, named = full(F.get("_p", F.lit(1))), full(F.get("_p", F.lit(2)))
    df = df.withColumns({"_said": said, "_named": F.filter(named, lambda s: ~strip(s).startswith("#"))})
    pair = lambda s: F.struct(strip(F.substring_index(s, "::", 1)).alias("actor"), strip(F.regexp_extract(s, r"(?s)^.*?::(.*)$", 1)).alias("replica"))
    entry = lambda s: F.transform(
        F.filter(F.transform(F.split(F.regexp_extract(s, "(?s)^[^=]*=(.*)$", 1), "[|]", -1), normalize_name), lambda a: a != ""),
        lambda a: F.struct(a.alias("key"), normalize_name(F.substring_index(s, "=", 1)).alias("value")),
    )
    entries = F.flatten(F.transform("_named", entry))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    error = (
        F.when(F.size("_p") < 2, "no list of replicas")
        .when(F.size("_p") > 3, "more than three sections")
        .when(F.exists("_said", lambda s: ~s.contains("::")), "a replica line without ::")
        .when(F.exists("_named", lambda s: ~s.contains("=")), "an alias line without =")
    )
    out = df.withColumns({"text": strip(F.get("_p", F.lit(0))), "pairs": F.transform("_said", pair), "aliases": F.map_from_entries(last), "error": error})
    return out.drop("_p", "_said", "_named")


def serialize(text: Column, pairs: Column, aliases: Column | None = None) -> Column:
    """The file of a text, pairs and, if given, aliases: map of canonical name to its aliases."""
    said = F.array_join(F.transform(pairs, lambda p: F.concat(p["actor"], F.lit("::"), p["replica"])), "\n")
    whole = F.concat(strip(text), F.lit(f"\n{DASHES}\n"), said)
    if aliases is not None:
        named = F.array_join(F.transform(F.map_entries(aliases), lambda e: F.concat(e["key"], F.lit(" = "), F.array_join(e["value"], " | "))), "\n")
        whole = F.concat(whole, F.when(F.size(aliases) > 0, F.concat(F.lit(f"\n{DASHES}\n"), named)).otherwise(""))
    return F.concat(whole, F.lit("\n"))


class Spaced:
    """A text with every run of white space as one space, by which words are found whatever is between them; offsets are those of the text itself."""

    def __init__(self, text: str) -> None:
        self.size, self.one, self.at = len(text), SPACES.sub(" ", text), 0
        self._after, self._lost, lost = [0], [0], 0
        for m in WIDE.finditer(text):
            self._after.append(m.start() - lost + 1)
            lost += m.end() - m.start() - 1
            self._lost.append(lost)

    def place(self, i: int) -> int:
        return i + self._lost[bisect_right(self._after, i) - 1]

    def find(self, needle: str) -> tuple[int, int] | None:
        """The first place of needle's words from where the last one found ended; nothing moves if there is none."""
        words = " ".join(needle.split())
        i = self.one.find(words, self.at)
        if i < 0:
            return None
        start = min(self.place(i), self.size)
        self.at = i + len(words)
        return start, self.place(self.at - 1) + 1 if words else start


def find_words(text: str, needle: str, at: int = 0) -> tuple[int, int] | None:
    """Where the words of needle stand in text from at on, whatever white space is between them."""
    found = Spaced(text[at:]).find(needle)
    return found and (found[0] + at, found[1] + at)


def to_doc(stem: str, text: str, pairs, aliases) -> dict:
    """Replicas are looked for one after the other; one that isn't found is left out with a warning."""
    canon = dict(aliases) if aliases is not None else {}
    key = lambda name: canon.get(n := collapsed(name).lower().translate(E_FOR_YO), n)
    others: dict = {}
    for alias, name in canon.items():
        others.setdefault(name, []).append(alias)
    ids: dict[str, str] = {}
    for name in [*others, *(key(p["actor"]) for p in pairs)]:
        if name != NOBODY:
            ids.setdefault(name, f"char_{len(ids)}")
    spaced, replicas = Spaced(text), []
    for p in pairs:
        if (span := spaced.find(p["replica"])) is None:
            warnings.warn(f"{stem}: not found: {p['replica'][:60]}", stacklevel=1)
            continue
        replicas.append(replica(*span, ids.get(key(p["actor"]))))
    people = [character(i, name, sorted(a for a in others.get(name, []) if a != name)) for name, i in ids.items()]
    return document(f"native/{stem}", "ru", "prose", "native", "annotator-owned", text, replicas, people, [])


def convert(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return to_docs(sections(whole_files(spark, path, "*.txt", recursive)))


def to_docs(parsed: DataFrame) -> DataFrame:
    """Documents of parsed files (columns stem, text, pairs, aliases); a file in error fails the job."""
    checked = parsed.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.col("stem"), F.lit(": "), F.col("error"))).cast("string")))
    entries = checked.withColumn("aliases", F.to_json("aliases"))
    return docs_by(entries, _doc, "stem", "text", "pairs", "aliases")


def _doc(stem: str, text: str, pairs: list[dict] | None, aliases: str | None) -> dict:
    return to_doc(stem, text, pairs or [], json.loads(aliases or "{}"))


def unlocatable(parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, missing): replicas listed but not found, by file."""
    listed = parsed.select(F.concat(F.lit("native/"), "stem").alias("doc_id"), F.size("pairs").alias("listed"))
    return listed.join(docs.select("doc_id", F.size("replicas").alias("found")), "doc_id").select("doc_id", (F.col("listed") - F.col("found")).alias("missing")).where("missing > 0")


def gold(parsed: DataFrame) -> DataFrame:
    """(path, seq, actor, replica) with canonical actors."""
    each = parsed.select("path", "aliases", F.posexplode("pairs").alias("seq", "p"))
    return each.select("path", "seq", canonical_actor(F.col("p.actor"), F.col("aliases")).alias("actor"), F.col("p.replica").alias("replica"))
