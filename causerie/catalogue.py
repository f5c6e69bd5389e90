"""A query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.functions import text as tx
from causerie.operators import annotation, attribution, evaluation, quality, replicas, sequences, tokens
from causerie.plans import plays
from causerie.shipping import new_path, ship
from causerie.sources import jsonl, markup, native, standoff
from causerie.sources.common import docs_by

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


COLLAPSED = "trim(regexp_replace({}, '[\\s]+', ' ', 'g'))"
SAID = COLLAPSED.format("text")
LAYOUT = f"""
    chunks AS (
        SELECT conv_id, turn, 0 AS kind, role AS chunk, role AS speaker FROM conversations WHERE role <> ''
        UNION ALL SELECT conv_id, turn, 1, {SAID}, role FROM conversations WHERE {SAID} <> ''),
    layout AS (
        SELECT *, CAST(coalesce(sum(length(chunk) + 1) OVER (PARTITION BY conv_id ORDER BY turn, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM chunks),
    placed AS (SELECT *, start + length(chunk) AS "end" FROM layout)"""


@query(f'WITH {LAYOUT} SELECT conv_id, turn, kind, chunk, start, CAST("end" AS BIGINT) AS "end", speaker FROM placed')
def drama_layout(spark, d):
    return plays.layout(read(spark, d, "conversations"))


@query(f"WITH {LAYOUT} SELECT 'play/' || conv_id AS doc_id, string_agg(chunk, chr(10) ORDER BY turn, kind) || chr(10) AS text, CAST(count(*) FILTER (kind = 1) AS INTEGER) AS n_replicas, CAST(count(*) FILTER (kind = 0) AS INTEGER) AS n_mentions, CAST(count(DISTINCT speaker) AS INTEGER) AS n_characters FROM placed GROUP BY conv_id")
def play_documents(spark, d):
    docs = plays.to_docs(read(spark, d, "conversations"))
    return docs.select("doc_id", "text", F.size("replicas").alias("n_replicas"), F.size("mentions").alias("n_mentions"), F.size("characters").alias("n_characters"))


@query(f"WITH {LAYOUT} SELECT 'play/' || conv_id AS doc_id, start AS start, speaker, chunk AS sliced FROM placed WHERE kind = 1")
def play_slices(spark, d):
    """Each replica's text, cut out of its document."""
    docs = plays.to_docs(read(spark, d, "conversations"))
    each = docs.select("doc_id", "text", F.explode("replicas").alias("r"))
    return each.select("doc_id", F.col("r.start").cast("bigint").alias("start"), "r.speaker", tx.slice_(F.col("text"), F.col("r.start"), F.col("r.end")).alias("sliced"))


#: Spans with faults: every third turn's reaches into the next line, those of turn 1 begin and end at one place, those of turn 4 end beyond the text.
FAULTS = 'CASE WHEN turn % 3 = 2 THEN "end" + 25 WHEN turn = 1 THEN start WHEN turn = 4 THEN 1000000 ELSE "end" END'
FAULTY = f"""{LAYOUT},
    sizes AS (SELECT conv_id, sum(length(chunk) + 1) AS size FROM placed GROUP BY conv_id),
    spans AS (SELECT conv_id, turn, start, CAST({FAULTS} AS BIGINT) AS "end", speaker FROM placed WHERE kind = 1),
    numbered AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY start) - 1 AS INTEGER) AS "at",
               coalesce(max("end") OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached
        FROM spans)"""


def faulty(spark, d) -> DataFrame:
    docs = plays.to_docs(read(spark, d, "conversations"))
    turns = read(spark, d, "conversations").where(tx.collapse(F.col("text")) != "").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    with_turns = docs.join(turns.select(F.concat(F.lit("play/"), F.col("conv_id").cast("string")).alias("doc_id"), "turns"), "doc_id")

    def spoil(r, i):
        turn = F.get("turns", i)
        end = F.when(turn % 3 == 2, r["end"] + 25).when(turn == 1, r["start"]).when(turn == 4, 1000000).otherwise(r["end"])
        return r.withField("end", end.cast("int"))

    return with_turns.withColumn("replicas", F.transform("replicas", spoil)).drop("turns")


@query(f"WITH {FAULTY} SELECT 'play/' || n.conv_id AS doc_id, \"at\" FROM numbered n JOIN sizes USING (conv_id) WHERE NOT (start >= 0 AND start < \"end\" AND \"end\" <= size)")
def validate_bounds(spark, d):
    return quality.validate(faulty(spark, d)).where("rule = 'replica_bounds'").select("doc_id", "at")


@query(f"WITH {FAULTY} SELECT 'play/' || conv_id AS doc_id, \"at\" FROM numbered WHERE start < reached")
def validate_overlap(spark, d):
    return quality.validate(faulty(spark, d)).where("rule = 'overlap'").select("doc_id", "at")


@query("SELECT 'play/' || conv_id AS doc_id, role AS detail FROM conversations WHERE role NOT IN ('user', 'assistant') AND " + f"{SAID} <> ''")
def unknown_speaker(spark, d):
    """Speakers that aren't on a roster of two."""
    docs = plays.to_docs(read(spark, d, "conversations")).withColumn("characters", F.filter("characters", lambda c: c["id"].isin("user", "assistant")))
    return quality.validate(docs).where("rule = 'unknown_speaker'").select("doc_id", "detail")


@query("SELECT 'play/' || conv_id AS doc_id, role AS detail FROM conversations GROUP BY conv_id, role")
def validate_duplicates(spark, d):
    """Every character listed twice."""
    docs = plays.to_docs(read(spark, d, "conversations"))
    return quality.validate(docs.withColumn("characters", F.concat("characters", "characters"))).where("rule = 'duplicate_character'").select("doc_id", "detail")


@query(f"WITH {LAYOUT} SELECT rule, count(*) AS n FROM (SELECT 'qtype' AS rule FROM placed WHERE kind = 1 UNION ALL SELECT 'cue_bounds' FROM placed WHERE kind = 1 UNION ALL SELECT 'domain' FROM placed GROUP BY conv_id UNION ALL SELECT 'mention_bounds' FROM placed WHERE kind = 0 UNION ALL SELECT 'unknown_mention' FROM placed WHERE kind = 0 UNION ALL SELECT 'unknown_addressee' FROM placed WHERE kind = 1) GROUP BY rule")
def validate_other_rules(spark, d):
    """All documents spoilt in six ways at once."""
    docs = plays.to_docs(read(spark, d, "conversations"))
    cue = F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"))
    docs = docs.withColumn("domain", F.lit("verse")).withColumn("replicas", F.transform("replicas", lambda r: r.withField("qtype", F.lit("odd")).withField("cue", cue).withField("addressee", F.lit("nobody"))))
    docs = docs.withColumn("mentions", F.transform("mentions", lambda m: m.withField("start", F.lit(-1)).withField("char", F.lit("ghost"))))
    return quality.validate(docs).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT doc_id, source, CAST('0x' || substr(sha1('documents/' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS share FROM documents)
    SELECT doc_id, CASE WHEN share < 0.2 THEN 'heldout' ELSE 'tune' END AS split FROM s""")
def split_of(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.split_of(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))).alias("split"))


@query("""
    SELECT count(*) AS n FROM conversations JOIN (SELECT DISTINCT conv_id FROM conversations WHERE CAST('0x' || substr(sha1('play/' || conv_id), 1, 8) AS BIGINT) / 4294967296.0 >= 0.2) USING (conv_id)""")
def convert_split(spark, d):
    """Turns in the plays of the tuning split."""
    return quality.keep_split(plays.to_docs(read(spark, d, "conversations")), "tune").agg(F.coalesce(F.sum(F.size("replicas")), F.lit(0)).alias("n"))


@query("SELECT source, lang, 'prose' AS domain, count(*) AS docs, CAST(0 AS BIGINT) AS replicas, CAST(0 AS BIGINT) AS characters FROM documents GROUP BY source, lang")
def corpus_stats(spark, d):
    return quality.corpus_stats(read(spark, d, "documents").select("source", "lang", F.lit("prose").alias("domain"), F.array().cast("array<int>").alias("replicas"), F.array().cast("array<int>").alias("characters")))


@query(f"WITH {LAYOUT} SELECT 'conversations' AS source, 'en' AS lang, 'drama' AS domain, count(DISTINCT conv_id) AS docs, count(*) FILTER (kind = 1) AS replicas, (SELECT count(*) FROM (SELECT DISTINCT conv_id, speaker FROM placed)) AS characters FROM placed")
def play_stats(spark, d):
    return quality.corpus_stats(plays.to_docs(read(spark, d, "conversations")))


@query(f"SELECT c_custkey, translate(lower({COLLAPSED.format('c_name')}), 'ё', 'е') AS name FROM customer")
def normalize_name(spark, d):
    return read(spark, d, "customer").select("c_custkey", tx.normalize_name(F.col("c_name")).alias("name"))


@query("SELECT conv_id, turn, CASE lower(role) WHEN 'assistant' THEN 'helper' WHEN 'system' THEN 'none' ELSE coalesce(lower(role), 'none') END AS actor FROM conversations")
def canonical_actor(spark, d):
    aliases = F.create_map(F.lit("assistant"), F.lit("helper"), F.lit("system"), F.lit("none"))
    return read(spark, d, "conversations").select("conv_id", "turn", tx.canonical_actor(F.col("role"), aliases).alias("actor"))


@query("SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'none' WHEN role = 'user' THEN 'guest' WHEN role = 'assistant' THEN 'helper' ELSE role END AS actor FROM conversations")
def pred_actor_key(spark, d):
    """By the surface form, then by the lemma, here the first letter."""
    aliases = F.create_map(F.lit("user"), F.lit("guest"), F.lit("a"), F.lit("helper"))
    return read(spark, d, "conversations").select("conv_id", "turn", tx.pred_actor_key(F.col("role"), F.left("role", F.lit(1)), aliases).alias("actor"))


@query("SELECT conv_id, turn, lag(role) OVER w AS before, role, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def triples(spark, d):
    return sequences.triples(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""
    WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations)
    SELECT conv_id, turn, role, (SELECT arg_max(c.role, c.turn) FROM conversations c WHERE c.conv_id = l.conv_id AND c.turn < l.turn AND c.role <> l.last) AS penult FROM l""")
def penult_speaker(spark, d):
    return sequences.penult(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations""")
def carry_forward(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked"))
    return sequences.carry_forward(turns, ["conv_id"], "turn", "asked").select("conv_id", "turn", "carried")


@query(f"WITH {LAYOUT}, w AS (SELECT conv_id, start, max(\"end\") OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM placed WHERE kind = 1) SELECT conv_id, CAST(reached AS BIGINT) AS gap_start, start AS gap_end FROM w WHERE reached < start")
def gaps(spark, d):
    return sequences.gaps(plays.layout(read(spark, d, "conversations")).where("kind = 1"), "conv_id")


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL"


@query(f"""
    WITH l AS ({LINES})
    SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, length(line) AS size FROM l""")
def line_numbers(spark, d):
    return sequences.numbered_lines(read(spark, d, "documents"), "doc_id").select("doc_id", "line_no", "start", F.char_length("line").cast("bigint").alias("size"))


@query(f"""
    WITH l AS ({LINES})
    SELECT doc_id, CAST(n AS INTEGER) AS line_no, md5(last_value(CASE WHEN {COLLAPSED.format('line')} <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS above FROM l""")
def line_above(spark, d):
    return sequences.line_above(read(spark, d, "documents"), "doc_id").select("doc_id", "line_no", F.md5("above").alias("above"))


@query("SELECT md5(text) AS key, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_wins_map(spark, d):
    return sequences.first_wins(read(spark, d, "documents").select(F.md5("text").alias("key"), "source", "doc_id"), "key", "source", ["doc_id"])


@query("SELECT md5(text) AS key, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def last_wins_map(spark, d):
    return sequences.last_wins(read(spark, d, "documents").select(F.md5("text").alias("key"), "source", "doc_id"), "key", "source", ["doc_id"])


@query("""
    WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS l FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS r FROM conversations WHERE role = 'assistant')
    SELECT conv_id, CAST(n AS INTEGER) AS n, l AS "left", r AS "right" FROM u JOIN a USING (conv_id, n)""")
def zip_positional(spark, d):
    turns = read(spark, d, "conversations")
    return sequences.zip_positional(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn", "turn", "turn")


@query("""
    WITH c AS (SELECT source AS name, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source)
    SELECT name, n FROM c ORDER BY n DESC, f LIMIT 15""")
def palette_top15(spark, d):
    return sequences.palette(read(spark, d, "documents"), "source", "doc_id")


@query(f"""
    WITH l AS ({LINES}), r AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS k FROM l)
    SELECT doc_id, md5(line) AS line, CAST(n AS INTEGER) AS line_no FROM r WHERE k = 1""")
def dedupe_ordered(spark, d):
    each = sequences.numbered_lines(read(spark, d, "documents"), "doc_id").select("doc_id", F.md5("line").alias("line"), "line_no")
    return sequences.dedupe_ordered(each, ["doc_id", "line"], ["line_no"])


@query("SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY 1")
def duplicate_ids(spark, d):
    """Texts that several documents have, by their digest."""
    return quality.repeated(read(spark, d, "documents").select(F.md5("text").alias("id")), "id")


COUNTED = """
    p AS (SELECT l.doc_id, d.lang, l.quality AS gold, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT {by} sum(gold) AS n_gold, sum(pred) AS n_pred, sum(gold * pred) AS n_matched, sum(CASE WHEN gold = 1 AND pred = 1 AND lang = 'en' THEN 1 ELSE 0 END) AS n_correct FROM p {group})
    SELECT {by} CAST(n_gold AS BIGINT) AS n_gold, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_correct AS BIGINT) AS n_correct,
           n_matched::DOUBLE / nullif(n_pred, 0)::DOUBLE AS precision, n_matched::DOUBLE / nullif(n_gold, 0)::DOUBLE AS recall,
           n_correct::DOUBLE / nullif(n_matched, 0)::DOUBLE AS attribution, n_correct::DOUBLE / nullif(n_gold, 0)::DOUBLE AS end_to_end FROM c"""


def _counted(spark, d) -> DataFrame:
    both = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    gold, pred = F.col("quality").cast("bigint"), (F.col("n_chars") >= 1000).cast("bigint")
    return both.select("doc_id", "lang", gold.alias("n_gold"), pred.alias("n_pred"), (gold * pred).alias("n_matched"), (gold * pred * (F.col("lang") == "en").cast("bigint")).alias("n_correct"))


@query("WITH " + COUNTED.format(by="", group=""))
def eval_metrics(spark, d):
    return evaluation.micro(_counted(spark, d))


@query("WITH " + COUNTED.format(by="lang,", group="GROUP BY lang"))
def eval_by_language(spark, d):
    return evaluation.micro(_counted(spark, d), "lang")


#: Predictions: the turns themselves, but those of turn 2 missing and those of turn 3 with another speaker. The query aligns all turns; SQL's join leaves out
#: texts that a conversation has more than once, so the two agree on tables without such texts only.
EDITED = f"""
    t AS (SELECT conv_id, turn, role, {SAID} AS said, CASE turn % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'anaphoric' ELSE 'implicit' END AS qtype, count(*) OVER (PARTITION BY conv_id, {SAID}) AS same FROM conversations),
    g AS (SELECT * FROM t WHERE said <> '' AND same = 1),
    p AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'somebody' ELSE role END AS actor FROM g WHERE turn <> 2)"""


def _edited(spark, d) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("replica", tx.collapse(F.col("text"))).where("replica <> ''")
    kind = F.when(F.col("turn") % 3 == 0, "explicit").when(F.col("turn") % 3 == 1, "anaphoric").otherwise("implicit")
    gold = turns.select("conv_id", F.col("turn").cast("int").alias("seq"), F.col("role").alias("actor"), "replica", kind.alias("qtype"))
    pred = gold.where("seq <> 2").withColumn("actor", F.when(F.col("seq") == 3, "somebody").otherwise(F.col("actor"))).drop("qtype")
    return evaluation.align(gold, pred, "conv_id")


@query(f"WITH {EDITED} SELECT g.conv_id, CAST(count(*) AS INTEGER) AS n_gold, CAST(count(p.turn) AS INTEGER) AS n_pred, CAST(count(p.turn) AS INTEGER) AS n_matched, CAST(count(*) FILTER (p.actor = g.role) AS INTEGER) AS n_correct FROM g LEFT JOIN p USING (conv_id, turn) GROUP BY g.conv_id")
def align_blocks(spark, d):
    return evaluation.counters(_edited(spark, d), "conv_id")


@query(f"WITH {EDITED} SELECT g.conv_id, CAST(g.turn AS INTEGER) AS seq, g.role AS gold, p.actor AS pred FROM g JOIN p USING (conv_id, turn) WHERE g.role <> p.actor")
def attribution_errors(spark, d):
    return evaluation.errors(_edited(spark, d), "conv_id").select("conv_id", "seq", "gold", "pred")


@query(f"""
    WITH {EDITED}, c AS (SELECT qtype, count(*) AS n_gold, count(p.turn) AS n_matched, count(*) FILTER (p.actor = g.role) AS n_correct FROM g LEFT JOIN p USING (conv_id, turn) GROUP BY qtype)
    SELECT qtype, n_gold, CAST(NULL AS BIGINT) AS n_pred, n_matched, n_correct, CAST(NULL AS DOUBLE) AS precision, n_matched::DOUBLE / n_gold::DOUBLE AS recall, n_correct::DOUBLE / nullif(n_matched, 0)::DOUBLE AS attribution, n_correct::DOUBLE / n_gold::DOUBLE AS end_to_end FROM c""")
def eval_by_qtype(spark, d):
    return evaluation.by_qtype(_edited(spark, d))


@query("""
    WITH i AS (SELECT count(*) AS n_issues FROM labels WHERE toxic = 1),
    x AS (SELECT count(*) FILTER (quality = 1) AS n_high, count(*) FILTER (quality = 0) AS n_low FROM labels)
    SELECT n_issues, n_high, n_low, n_issues = 0 AND n_high = 0 AS clean FROM i, x""")
def audit_gate(spark, d):
    labels = read(spark, d, "labels")
    return quality.audit(labels.where("toxic = 1"), labels.select(F.when(F.col("quality") == 1, "somebody").otherwise("none").alias("pred")))


@query("""
    WITH b AS (SELECT item_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, item_id, CAST(strpos(d.t, b.t) - 1 AS INTEGER) AS at FROM d, b WHERE b.t <> '' AND strpos(d.t, b.t) > 0""")
def locate_span(spark, d):
    """The first place of each benchmark text in each document, whatever white space is between its words."""
    docs = read(spark, d, "documents").select("doc_id", tx.collapse(F.col("text")).alias("t"))
    items = read(spark, d, "benchmark").select("item_id", tx.collapse(F.col("text")).alias("b")).where("b <> ''")
    return sequences.locate(docs, items)


@query("""
    SELECT doc_id, CAST(nullif(strpos(substr(text, 1, 300), 'the'), 0) - 1 AS INTEGER) AS first_in,
           CASE WHEN strpos(reverse(substr(text, 101, 300)), 'eht') > 0 THEN CAST(100 + length(substr(text, 101, 300)) - strpos(reverse(substr(text, 101, 300)), 'eht') - 3 + 1 AS INTEGER) END AS last_in
    FROM documents WHERE text IS NOT NULL""")
def cue_window(spark, d):
    """The first cue of a window, and the last one of another."""
    docs, cue = read(spark, d, "documents").where("text IS NOT NULL"), F.lit("the")
    first, last = tx.find(F.col("text"), cue, F.lit(0), F.lit(300)), tx.rfind(F.col("text"), cue, F.lit(100), F.lit(400))
    return docs.select("doc_id", first.cast("int").alias("first_in"), last.cast("int").alias("last_in"))


@query(f"WITH t AS (SELECT conv_id, turn, {SAID} AS said FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, said AS replica FROM t WHERE said <> ''")
def dash_replicas(spark, d):
    """Speech taken out of prose that the turns were written into, a dash before each."""
    return replicas.replicas(plays.prose(read(spark, d, "conversations"))).select("doc_id", "seq", "replica")


@query(f"WITH t AS (SELECT conv_id, turn, {SAID} AS said FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, said AS replica, 'after_starting' AS tag FROM t WHERE said <> ''")
def quote_replicas(spark, d):
    """The same in quotes after the role and a colon."""
    return replicas.replicas(plays.prose(read(spark, d, "conversations"), "quote")).select("doc_id", "seq", "replica", "tag")


@query(f"WITH t AS (SELECT conv_id, turn, {SAID} AS said FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM t WHERE said <> '') SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq % 2 = 0 THEN 'Анна' ELSE 'Пётр' END AS actor, CASE WHEN seq < 2 THEN 'named_after' ELSE 'alternation' END AS rule FROM n")
def alternation(spark, d):
    """Two speakers who are named at the start and then speak in turn."""
    turns = read(spark, d, "conversations").withColumn("said", tx.collapse(F.col("text"))).where("said <> ''")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    note = F.when(n == 1, ", – сказала Анна.").when(n == 2, ", – ответил Пётр.").otherwise("")
    lines = turns.select("conv_id", "turn", F.concat(F.lit("– "), "said", note).alias("line")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("l"))
    docs = lines.select(F.col("conv_id").cast("string").alias("doc_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return attribution.lines(docs).select("doc_id", "seq", "actor", "rule")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[-’''][\\p{L}\\p{N}_]+)*')) AS BIGINT) AS n_words FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')")
def token_counts(spark, d):
    found = tokens.tokens(read(spark, d, "documents").select("doc_id", "text"), "text", "is_word")
    return found.where(F.col("is_word") | F.col("text").startswith("_")).groupBy("doc_id").agg(F.count("*").alias("n_words"))


@query(f"WITH {LAYOUT} SELECT 'play/' || conv_id AS doc_id, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", speaker, CAST(NULL AS VARCHAR) AS qtype FROM placed WHERE kind = 1")
def jsonl_roundtrip(spark, d):
    """Plays written as lines of JSON and read again."""
    path = new_path(spark, "jsonl")
    jsonl.write(plays.to_docs(read(spark, d, "conversations")), path)
    return jsonl.read(spark, path).select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker", "r.qtype")


def _files(spark, d, line, join: str, head: str, tail: str) -> DataFrame:
    """(stem, content): a file a conversation, a line a turn."""
    turns = read(spark, d, "conversations").withColumn("said", tx.collapse(F.col("text"))).where("said <> ''")
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return each.select(F.format_string("%06d", "conv_id").alias("stem"), F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), join), F.lit(tail)).alias("content"))


PARSED = f"""
    t AS (SELECT conv_id, turn, role, {SAID} AS said FROM conversations),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq FROM t WHERE said <> '')"""


@query(f"WITH {PARSED} SELECT printf('%06d', conv_id) AS stem, seq, role AS actor, said AS replica FROM n")
def native_sections(spark, d):
    """Annotated files written from the turns, taken apart again in Spark's own functions."""
    turns = read(spark, d, "conversations").withColumn("said", tx.collapse(F.col("text"))).where("said <> ''")
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("actor"), F.col("said").alias("replica")).alias("p")))).alias("l"))
    pairs = F.transform("l", lambda x: x["p"])
    aliases = F.create_map(F.lit("helper"), F.array(F.lit("assistant")))
    files = each.select(F.format_string("%06d", "conv_id").alias("stem"), native.serialize(F.array_join(F.transform("l", lambda x: x["p"]["replica"]), "\n"), pairs, aliases).alias("content"))
    return native.sections(files).select("stem", F.posexplode("pairs").alias("seq", "p")).select("stem", "seq", "p.actor", "p.replica")


@query(f"WITH {PARSED}, s AS (SELECT *, CAST(coalesce(sum(length(said) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM n) SELECT 'native/' || printf('%06d', conv_id) AS doc_id, start, CAST(start + length(said) AS INTEGER) AS \"end\" FROM s")
def native_documents(spark, d):
    docs = native.to_docs(native.sections(native_files(spark, d)))
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end")


def native_files(spark, d) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("said", tx.collapse(F.col("text"))).where("said <> ''")
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("actor"), F.col("said").alias("replica")).alias("p")))).alias("l"))
    pairs = F.transform("l", lambda x: x["p"])
    return each.select(F.format_string("%06d", "conv_id").alias("stem"), native.serialize(F.array_join(F.transform(pairs, lambda p: p["replica"]), "\n"), pairs).alias("content"))


def _esc(c):
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


@query(f"WITH {LAYOUT} SELECT 'rusdracor/' || printf('%06d', conv_id) AS doc_id, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", CASE WHEN speaker = 'system' THEN NULL ELSE speaker END AS speaker FROM placed p WHERE kind = 1")
def tei_documents(spark, d):
    """Plays in TEI written from the turns; system isn't in the list of persons."""
    docs = docs_by(tei_files(spark, d), markup.parse_tei, "stem", "content")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker")


def tei_files(spark, d) -> DataFrame:
    line = F.concat(F.lit('<sp who="#'), "role", F.lit('"><speaker>'), "role", F.lit("</speaker><p>"), _esc(F.col("said")), F.lit("</p></sp>"))
    head = '<TEI xmlns="urn:tei"><person xml:id="user" sex="MALE"><persName>User</persName></person><person xml:id="assistant"><persName>Assistant</persName></person><body>'
    return _files(spark, d, line, "\n", head, "</body></TEI>")


RUNNING = 'CAST(coalesce(sum(length(said) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER)'


@query(f"WITH {PARSED}, s AS (SELECT *, {RUNNING} AS start FROM n) SELECT 'quoteli3/' || printf('%06d', conv_id) AS doc_id, start, CAST(start + length(said) AS INTEGER) AS \"end\", CASE role WHEN 'user' THEN 'char_0' WHEN 'assistant' THEN 'char_1' END AS speaker FROM s")
def quote_xml_documents(spark, d):
    docs = docs_by(quote_xml_files(spark, d), markup.parse_quotes, "stem", "content")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker")


def quote_xml_files(spark, d) -> DataFrame:
    line = F.concat(F.lit('<quote speaker="'), "role", F.lit('">'), _esc(F.col("said")), F.lit("</quote>"))
    head = '<doc><characters><character name="User" aliases="user;User" gender="male"/><character name="Assistant" aliases="assistant"/></characters><text>'
    return _files(spark, d, line, "\n", head, "</text></doc>")


def _placed(spark, d) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("said", tx.collapse(F.col("text"))).where("said <> ''")
    return sequences.offsets(turns, "conv_id", ["turn"], F.char_length("said")).withColumn("stop", F.col("start") + F.char_length("said"))


@query(f"WITH {PARSED}, s AS (SELECT *, {RUNNING} AS start FROM n) SELECT 'riqua/' || printf('%06d', conv_id) AS doc_id, start, CAST(start + length(said) AS INTEGER) AS \"end\", 'char_0' AS speaker FROM s")
def brat_documents(spark, d):
    """Texts with standoff notes: each turn a quote, spoken by an entity at the first characters of the text."""
    docs = docs_by(brat_files(spark, d), standoff.parse_brat, "stem", "content", "notes")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker")


def brat_files(spark, d) -> DataFrame:
    rows = _placed(spark, d)
    quote = F.format_string("T%d\tQuote %d %d\tx", F.col("turn") + 10, "start", "stop")
    said = F.format_string("R%d\tSpeaker Arg1:T%d Arg2:T1", "turn", F.col("turn") + 10)
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", quote.alias("q"), said.alias("r")))).alias("l"))
    notes = F.concat(F.lit("T1\tEntity 0 2\tx\n"), F.array_join(F.transform("l", lambda x: x["q"]), "\n"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["r"]), "\n"))
    return each.select(F.format_string("%06d", "conv_id").alias("stem"), F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("content"), notes.alias("notes"))


@query(f"WITH {PARSED}, s AS (SELECT *, {RUNNING} AS start FROM n) SELECT 'droc/' || printf('%06d', conv_id) AS doc_id, start, CAST(start + length(said) AS INTEGER) AS \"end\", 'char_' || turn AS speaker, CASE WHEN role = 'user' THEN 'thought' ELSE 'speech' END AS mode FROM s WHERE role <> 'system'")
def xmi_documents(spark, d):
    """UIMA files: each turn with an entity of its own; what system says is of an unknown category."""
    docs = docs_by(xmi_files(spark, d), markup.parse_xmi, "stem", "content")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker", "r.mode")


def xmi_files(spark, d) -> DataFrame:
    rows = _placed(spark, d)
    kind = F.when(F.col("role") == "user", "thought").when(F.col("role") == "system", "name").otherwise("directspeech")
    xml = F.format_string('<type:NamedEntity xmi:id="%d" begin="0" end="1" Name="er" ID="%d"/><type:DirectSpeech begin="%d" end="%d" Speaker="%d" Category="%s"/>', F.col("turn") + 10, "turn", "start", "stop", F.col("turn") + 10, kind)
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", xml.alias("x")))).alias("l"))
    head = '<xmi:XMI xmlns:type="urn:t" xmlns:cas="urn:c" xmlns:xmi="urn:x"><cas:Sofa sofaString="'
    text = F.array_join(F.transform("l", lambda x: _esc(x["said"])), "&#10;")
    return each.select(F.format_string("%06d", "conv_id").alias("stem"), F.concat(F.lit(head), text, F.lit('"/>'), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</xmi:XMI>")).alias("content"))


@query(f"WITH {PARSED}, s AS (SELECT *, {RUNNING} AS start FROM n) SELECT 'pdnc/' || printf('%06d', conv_id) AS doc_id, start, CAST(start + length(said) AS INTEGER) AS \"end\", CASE role WHEN 'user' THEN 'char_0' WHEN 'assistant' THEN 'char_1' END AS speaker, CASE WHEN role = 'user' THEN 'explicit' END AS qtype FROM s")
def novel_documents(spark, d):
    docs = docs_by(novel_files(spark, d), standoff.parse_novel, "stem", "content", "people", "quotes")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker", "r.qtype")


def novel_files(spark, d) -> DataFrame:
    rows = _placed(spark, d)
    kind = F.when(F.col("role") == "user", "Explicit").otherwise("Odd")
    row = F.format_string('"Q%d","%s","%s","[[%d, %d]]","[]","nan"', "turn", "role", kind, "start", "stop")
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", row.alias("x")))).alias("l"))
    head = "quoteID,speaker,quoteType,quoteByteSpans,addressees,referringExpression\n"
    people = "Character ID,Main Name,Aliases,Gender,Category\n0,User,\"{'user', 'User'}\",F,major\n1,Assistant,\"['assistant']\",M,major\n"
    return each.select(F.format_string("%06d", "conv_id").alias("stem"), F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("content"), F.lit(people).alias("people"), F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["x"]), "\n")).alias("quotes"))


@query(f"WITH {PARSED} SELECT printf('jy_quoteplus/%06d/%05d', conv_id, seq) AS doc_id, 1 AS start, CAST(1 + length(said) AS INTEGER) AS \"end\", 'char_0' AS speaker FROM n")
def quote_json_documents(spark, d):
    items = quote_json_files(spark, d).select("stem", F.posexplode(F.from_json("content", "array<string>")).alias("n", "item"))
    docs = docs_by(items.select(F.format_string("jy_quoteplus/%s/%05d", "stem", "n").alias("doc_id"), "item"), standoff.parse_quote, "doc_id", "item")
    return docs.select("doc_id", F.explode("replicas").alias("r")).select("doc_id", "r.start", "r.end", "r.speaker")


def quote_json_files(spark, d) -> DataFrame:
    item = F.to_json(F.struct(F.col("said").alias("quote"), F.concat(F.lit("“"), "said", F.lit("”")).alias("context"), F.struct(F.col("role").alias("说话人-entity")).alias("labels")))
    return _files(spark, d, item, ",\n", "[", "]")


@query("SELECT conv_id, count(*) FILTER (role IN ('assistant', 'system')) AS confirmed, count(*) AS n, count(*) FILTER (role IN ('assistant', 'system'))::DOUBLE / count(*)::DOUBLE AS progress FROM conversations GROUP BY conv_id")
def annotation_progress(spark, d):
    """Turns of one role are confirmed, those of another bogus."""
    return annotation.progress(read(spark, d, "conversations"), "conv_id", F.col("role") == "assistant", F.col("role") == "system")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ()) ")
def grouping_report(spark, d):
    return read(spark, d, "documents").groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"))


from causerie import catalogue_annotated, catalogue_files  # noqa: E402, F401  they add their queries
