"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causerie.llm.common import table


def expand_turns(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One training example for each turn of target_role: (conv_id, turn, n_context, text, loss_start, loss_end).

    A turn is written "<|role|>\\n" + text + "<|end|>\\n". text holds all turns before the target, in order,
    then the target; only the characters [loss_start, loss_end), the target's own text with its end mark,
    are trainable.

    Turns are ordered by (turn, role, text), null first. A null role is written "unknown" and is no target; a
    null text is empty. Repeated rows are turns of their own. Rows of a null conv_id form one conversation.
    A target with nothing before it has an empty context. Very long texts are written whole, in every example that holds them. An empty table gives no rows. Other columns are
    not read.

    One shuffle by conv_id; a conversation is put together in one row, as its examples are.
    """
    said = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    text = lambda t: F.coalesce(t["text"], F.lit(""))
    head = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))
    end = "<|end|>\n"
    shown = turns.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(head(t), text(t), F.lit(end))).alias("shown"))
    each = shown.select("conv_id", "shown", F.posexplode("turns").alias("at", "t")).where(F.col("t.role") == target_role)
    context = F.array_join(F.slice("shown", F.lit(1), F.col("at")), "")
    made = each.select("conv_id", F.col("t.turn").alias("turn"), F.col("at").alias("n_context"), context.alias("context"), head(F.col("t")).alias("head"), F.concat(text(F.col("t")), F.lit(end)).alias("reply"))
    start = F.char_length("context") + F.char_length("head")
    return made.select("conv_id", "turn", "n_context", F.concat("context", "head", "reply").alias("text"), start.alias("loss_start"), (start + F.char_length("reply")).alias("loss_end"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_turns(table(spark, sf_dir, "conversations"))


SQL = {
    "op7_chat_formatting": """
        WITH shown AS (
            SELECT conv_id, turn, role, text, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
            FROM conversations),
        placed AS (
            SELECT *, coalesce(string_agg(head || body, '') OVER before, '') AS context, CAST(count(*) OVER before AS INTEGER) AS n_context
            FROM shown
            WINDOW before AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, turn, n_context, context || head || body AS text,
               CAST(length(context) + length(head) AS INTEGER) AS loss_start, CAST(length(context) + length(head) + length(body) AS INTEGER) AS loss_end
        FROM placed WHERE role = 'assistant'
    """
}
QUERIES = {"op7_chat_formatting": op7_chat_formatting}
