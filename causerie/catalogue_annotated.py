"""Queries for the operators on annotated tokens: scenes rendered from conversations by rule, and their SQL by the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from causerie.catalogue import SAID, query, read
from causerie.operators import annotated
from causerie.plans import scenes

Rows = list[tuple[str, str | None, str]]

_PICK = "CAST(conv_id % 3 AS INTEGER) + 1"
_NAMED = "replace(replace({}, '@A', ({})[{p}]), '@B', ({})[{p}])"


def _with_names(c: str) -> str:
    return _NAMED.format(c, list(scenes.WOMEN), list(scenes.MEN), p=_PICK)


def _values(rows: Rows) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({n}, {quote(said)}, {quote(who)}, {quote(rule)})" for n, (said, who, rule) in enumerate(rows))


def _expected(rows: Rows, first: Rows, cycle: list[Rows]) -> str:
    """Lines of a scene: rows, then those of the line that follows once a turn, at first and then in a cycle."""
    each = len(first) or 1
    parts = [f"SELECT conv_id, j AS seq, said, who, rule FROM convs, (VALUES {_values(rows)}) v(j, said, who, rule)"] if rows else []
    if first:
        parts.append(f"SELECT conv_id, {len(rows)} + j AS seq, said, who, rule FROM convs, (VALUES {_values(first)}) v(j, said, who, rule)")
        for c, again in enumerate(cycle):
            parts.append(f"SELECT conv_id, {len(rows)} + {each} * k + j, said, who, rule FROM (SELECT conv_id, unnest(range(1, n)) AS k FROM convs), (VALUES {_values(again)}) v(j, said, who, rule) WHERE (k - 1) % {len(cycle)} = {c}")
    return f"""WITH convs AS (SELECT conv_id, count(*) AS n FROM conversations WHERE {SAID} <> '' GROUP BY conv_id), x AS ({" UNION ALL ".join(parts)})
        SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(seq AS INTEGER) AS seq, {_with_names("said")} AS replica, {_with_names("who")} AS actor, rule FROM x"""


A, B = ("Да ,", "@A", "named_after"), ("Да ,", "@B", "named_after")
DA = "Да ."
#: What each scene comes to: (rows, those of the first line that follows, those of later ones in turn).
EXPECTED: dict[str, tuple[Rows, Rows, list[Rows]]] = {
    "same_line": ([("Пойдём ,", "@A", "named_inside"), ("Уже поздно .", "@A", "same_line")], *([x := [("Да ,", "@B", "named_inside"), ("Нет .", "@B", "same_line")], [x]])),
    "named_after": ([], [B], [[B]]),
    "named_before": ([("Стой !", "@A", "named_before")], [], []),
    "alternation": ([A, B], [(DA, "@A", "alternation")], [[(DA, "@B", "alternation")], [(DA, "@A", "alternation")]]),
    "imperatives": ([A, B], [("Иди !", "@A", "alternation")], [[("Иди !", "@A", "imperatives")]]),
    "goes_on": ([A, ("Нет .", "@A", "goes_on")], [], []),
    "voice_intro": ([("Стой !", "@A", "named_before"), ("Иду .", "@A", "voice_intro")], [], []),
    "long_intro": ([B, A, ("Завтра пойдём туда мы .", "@A", "long_intro")], [], []),
    "named_above": ([A, B, (DA, "@B", "named_above")], [], []),
    "named_before_vague": ([A, ("Да ,", "один", "named_after"), ("Ты кто ?", "старик", "named_after"), ("Я .", "@A", "named_before_vague")], [], []),
    "reflexive": ([A, ("Видит себя .", "@A", "reflexive")], [], []),
    "no_subject": ([A, ("Видишь .", "@A", "no_subject")], [], []),
    "above_previous": ([A, (DA, "@B", "above_previous")], [], []),
    "before_previous": ([("Стой .", "@B", "named_before"), (DA, "@B", "before_previous")], [], []),
    "penult": ([A, B, ("Да ,", "@A", "penult")], [], []),
    "answer": ([A, ("Ты где ,", "@B", "named_after"), ("Я тут ,", "@A", "answer")], [], []),
    "line_above": ([B, ("Да ,", "@A", "line_above")], [], []),
    "bracketed": ([A, B, ("Да ,", "@A", "penult"), ("Нет .", "@A", "same_line")], [], []),
    "between": ([A, B, (DA, "@A", "between")], [], []),
    "spoke_before": ([A, B, (DA, "@B", "spoke_before")], [], []),
    "between_reflexive": ([A, B, ("Жалко себя .", "@B", "reflexive")], [], []),
    "not_again": ([A, B, (DA, "@A", "not_again")], [], []),
    "turns": ([A, B, (DA, "@A", "turns")], [], []),
    "not_collective": ([A, B, (DA, "@A", "not_collective")], [], []),
    "last": ([A, (DA, "@A", "last")], [], []),
    "nobody": ([(DA, None, "none")], [], []),
    "pronoun": ([A], [], []),
    "pronoun_recent": ([A, B], [A], [[A]]),
    "nominative": ([A], [], []),
    "generic": ([A, B, ("Нет ,", "@A", "named_after")], [], []),
    "sounds": ([("Бах – бах ! – бах ,", "@A", "named_after")], [], []),
    "tail": ([("Ты где , – сказала @A , тебе видно ?", None, "penult"), (DA, None, "same_line")], [], []),
    "after_comma": ([("Да ,", "@A", "named_inside"), ("пойдём .", "@A", "same_line")], [], []),
    "after_brackets": ([("Да !", "@A", "named_inside"), ("Пойдём .", "@A", "same_line")], [], []),
    "no_note": ([("Дом , – вижу я .", None, "none")], [], []),
}


def _scene_query(name: str):
    lines, more = scenes.SCENES[name]

    def run(spark, d):
        return annotated.lines(scenes.tokens(read(spark, d, "conversations"), lines, more)).select("doc_id", "seq", "replica", "actor", "rule")

    run.__name__ = f"rule_{name}"
    run.__doc__ = f"Speakers of the scene {name}, a document a conversation."
    return run


for _name in scenes.SCENES:
    query(_expected(*EXPECTED[_name]))(_scene_query(_name))


def _portrait(spark, d):
    return scenes.tokens(read(spark, d, "conversations"), scenes.PORTRAIT)


def _times(columns: str, rows: list[tuple], select: str) -> str:
    """SQL: rows for each conversation."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"WITH convs AS (SELECT DISTINCT conv_id FROM conversations WHERE {SAID} <> '') SELECT CAST(conv_id AS VARCHAR) AS doc_id, {select} FROM convs, (VALUES {values}) v({columns})"


#: Words of the portrait: (word, sentence, chunk, gender of the chunk, what the phrase tells: person, reference, vague, indefinite, generic, collective, inanimate, named).
_MILLER, _ONE, _VOICE = "Старый мельник с ножом", "Один из них", "Женский голос"
_WORDS = [
    *((i, 1, _MILLER, "Masc", "10000000") for i in range(4)),
    (4, 1, "вышел", "Masc", "00000000"),
    *((i, 2, _ONE, "Masc", "11110100") for i in (6, 7, 8)),
    (9, 2, "молчал", "Masc", "00000000"),
    (11, 3, "Женщина", "Fem", "10001000"),
    (12, 3, "взяла", "Fem", "00000000"),
    (13, 3, "дом", "Masc", "00000010"),
    (15, 4, "Солдаты", "Masc", "10000100"),
    (16, 4, "ждали", None, "00000100"),
    (17, 4, "себя", None, "01110000"),
    *((i, 5, _VOICE, "Fem", "01000010") for i in (19, 20)),
    (21, 5, "звучал", "Masc", "00000000"),
    (23, 6, "Кто", None, "01110000"),
    (24, 6, "пришёл", "Masc", "00000000"),
    (26, 7, "@A", "Fem", "10000001"),
    (28, 7, "@B", "Masc", "10000001"),
    (30, 8, "Она", "Fem", "11000000"),
    (31, 8, "была", "Fem", "00000000"),
    (32, 8, "врач", "Masc", "10000000"),
]
_FLAGS = ("person", "reference", "vague", "indefinite", "generic", "collective", "inanimate", "named")


@query(_times("i, sentence, chunk, gender, flags", _WORDS, f"CAST(i AS INTEGER) AS i, CAST(sentence AS INTEGER) AS sentence, {_with_names('chunk')} AS chunk, {_with_names('chunk')} AS phrase, lower({_with_names('chunk')}) AS key, gender, flags"))
def noun_phrases(spark, d):
    """Chunks, phrases and what they tell, a row a word of the portrait."""
    found = annotated.phrases(_portrait(spark, d))
    return found.select("doc_id", "i", "sentence", "chunk", "phrase", "key", "gender", F.concat(*(F.col(c).cast("int").cast("string") for c in _FLAGS)).alias("flags"))


#: (sentence, verb, candidate, score, best): length, subject, class, case, person and thing weighed.
_CANDIDATES = [(1, 4, 1, 10, 1), (2, 9, 6, 10, 1), (3, 12, 11, 8, 1), (3, 12, 13, -9, 0), (4, 16, 15, 8, 1), (4, 16, 17, -10, 0), (5, 21, 20, 7, 1), (6, 24, 23, -1, 0), (6, 24, 26, 11, 1), (6, 24, 28, 11, 0), (8, 32, 30, 3, 1)]


@query(_times("sentence, verb, candidate, score, best", _CANDIDATES, "CAST(sentence AS INTEGER) AS sentence, CAST(verb AS INTEGER) AS verb, CAST(candidate AS INTEGER) AS candidate, CAST(score AS INTEGER) AS score, best = 1 AS best"))
def speaker_candidates(spark, d):
    """Verbs, who may act, and their scores, by sentence."""
    return annotated.candidates(_portrait(spark, d))


#: Lines with the author's words in them, and the patterns that fit.
_NOTED_LINES = [scenes.ASK_A, scenes.SCENES["same_line"][0][0], scenes.SCENES["after_comma"][0][0], scenes.SCENES["after_brackets"][0][0], scenes.SCENES["no_note"][0][0], scenes.SCENES["sounds"][0][0], "– да , – вижу:видеть:VERB:parataxis:1:1s дом:дом:NOUN:obj:4:asmI ."]
_NOTED = [
    (3, "ending", "сказала @A", 1),
    (10, "insertion", "сказала @A", 1),
    (10, "ending", "сказала @A . – Уже поздно", 1),
    (21, "insertion", "сказала @A", 1),
    (21, "ending", "сказала @A , – пойдём", 1),
    (31, "insertion", "сказала @A", 1),
    (31, "ending", "сказала @A . ) – Пойдём", 1),
    (42, "ending", "вижу я", 0),
    (51, "ending", "бах , – сказала @A", 1),
    (54, "ending", "сказала @A", 1),
    (61, "ending", "вижу дом", 0),
]


@query(_times("i, pattern, note, by_author", _NOTED, f"CAST(i AS INTEGER) AS i, pattern, {_with_names('note')} AS note, by_author = 1 AS by_author"))
def author_notes(spark, d):
    """The patterns of the author's words, at every hyphen after a mark."""
    return annotated.notes(scenes.tokens(read(spark, d, "conversations"), _NOTED_LINES))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(7 * (turn_no - 1) AS INTEGER) AS i, CASE WHEN turn_no % 2 = 1 THEN 'VERB' ELSE 'NOUN' END AS pos FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations WHERE " + SAID + " <> '')")
def misread_words(spark, d):
    """One surface form that the annotator misreads, forced to be a verb, in any case; words of other forms stay."""
    from causerie.language import corrected

    both = scenes.tokens(read(spark, d, "conversations"), [], "Шепчет:шептать:NOUN:ROOT:.:ns тихо ветер:ветер:NOUN:nsubj:0:nsmI в:в:ADP:case:4 поле:поле:NOUN:obl:0 ещё .")
    odd = both.withColumn("text", F.when((F.col("i") % 14 == 7) & (F.col("text") == "Шепчет"), "Шёпот").otherwise(F.col("text")))
    return corrected(odd, {"шепчет": "VERB"}).where("i % 7 = 0").select("doc_id", "i", "pos")
