"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causerie.llm.common import fresh, n_tokens, table, written

#: Budgets as shares of all tokens; each smaller mix is part of the larger ones.
BUDGETS = (0.25, 0.5, 1.0)
#: A 60-bit hash is refined by its first 12 bits, the next 12, then exactly.
HASH_BITS = 60
SHIFTS = (48, 36, 0)
EVERYTHING = 1 << HASH_BITS


def hash60(id_: Column) -> Column:
    """The first 60 bits of the MD5 of an id; a null id counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def thresholds(slim: DataFrame, budgets: tuple[float, ...] = BUDGETS, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, level, threshold) from rows of (source, h, n_tokens): those of a source with h < threshold make up its part of budget number level.

    Of a budget of T tokens a source of weight w gets T * w / (sum of weights), and never more than it has. The
    default weight is the square root of the source's tokens, rounded down: large sources are toned down.

    Tokens are summed by (source, leading bits of the hash). A running sum over at most 4096 buckets a source finds the bucket
    in which the budget runs out; only that bucket's rows are summed again by the following bits. No documents are sorted.
    """
    tokens = slim.groupBy("source", F.shiftright("h", SHIFTS[0]).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    hist = written(tokens, "mix-histogram")
    totals = hist.groupBy("source").agg(F.sum("n").cast("double").alias("has"))
    if weights is None:
        weight = F.floor(F.sqrt("has")).cast("double")
    else:
        weight = reduce(lambda rest, kv: F.when(F.col("source") == kv[0], F.lit(float(kv[1]))).otherwise(rest), weights.items(), F.lit(0.0))
    weighed = totals.withColumn("w", weight)
    whole = weighed.agg(F.sum("w").alias("all_w"), F.sum("has").alias("all_tokens"))
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(float(b)).alias("share")) for i, b in enumerate(sorted(budgets)))))
    edge = weighed.crossJoin(whole).select("*", levels.alias("l")).select("source", F.col("l.level").alias("level"), F.when(F.col("all_w") > 0, F.floor(F.col("all_tokens") * F.col("l.share") * F.col("w") / F.col("all_w"))).otherwise(0).cast("bigint").alias("budget"), F.lit(0).cast("bigint").alias("base"))

    def run_out(counts: DataFrame) -> DataFrame:
        so_far = F.col("base") + F.sum("n").over(Window.partitionBy("source", "level").orderBy("bucket"))
        over = counts.withColumn("so_far", so_far).where("so_far > budget")
        first = over.groupBy("source", "level").agg(F.min(F.struct("bucket", (F.col("so_far") - F.col("n")).alias("base"), "budget")).alias("b"))
        return first.select("source", "level", "b.budget", "b.base", F.col("b.bucket").alias("bucket"))

    edge = written(edge, "mix-budgets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    found = written(run_out(hist.join(edge, same(hist, edge)).select(edge["source"], "level", "budget", "base", "bucket", "n")), "mix-edge-0")
    for i in range(1, len(SHIFTS)):
        inside = slim.join(found, same(slim, found) & (F.shiftright(slim["h"], SHIFTS[i - 1]) == found["bucket"]))
        counts = inside.groupBy(found["source"], "level", "budget", "base", F.shiftright("h", SHIFTS[i]).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        found = written(run_out(counts), f"mix-edge-{i}")
    every = edge.select("source", "level").alias("e")
    cut = found.alias("f")
    joined = every.join(cut, F.col("e.source").eqNullSafe(F.col("f.source")) & (F.col("e.level") == F.col("f.level")), "left")
    return written(joined.select("e.source", "e.level", F.coalesce("f.bucket", F.lit(EVERYTHING)).alias("threshold")), "mix-thresholds")


def _levels(cuts: DataFrame, budgets: tuple[float, ...]) -> DataFrame:
    return cuts.groupBy("source").agg(*(F.max(F.when(F.col("level") == i, F.col("threshold"))).alias(f"t{i}") for i in range(len(budgets))))


def mix(docs: DataFrame, budgets: tuple[float, ...] = BUDGETS, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, n_tokens, budget) of the rows that are in the largest mix; budget: the smallest share of all tokens whose mix has them.

    Of each source the rows of the smallest id hashes are taken, as many as fit in its part of the budget (see thresholds).
    Rows of one id have one hash and are in together or out together. A null source is a source; a null id counts as ''; null texts
    have 0 tokens. Rows of 0 tokens are in if their hash is below the threshold. An empty table gives no rows. Other columns are not read.
    """
    slim = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), hash60(F.col(id_col)).alias("h"), n_tokens(F.col(text_col)).alias("n_tokens")), "mix-rows")
    cuts = written(_levels(thresholds(slim.select("source", "h", "n_tokens"), budgets, weights), budgets), "mix-cuts")
    kept = slim.join(cuts, slim["source"].eqNullSafe(cuts["source"])).where(F.col("h") < F.col(f"t{len(budgets) - 1}"))
    smallest = F.coalesce(*(F.when(F.col("h") < F.col(f"t{i}"), F.lit(float(b))) for i, b in enumerate(sorted(budgets))))
    return kept.select(F.col("id").alias(id_col), slim["source"].alias(source_col), "n_tokens", smallest.alias("budget"))


def keep_mix(docs: DataFrame, budget: float = 1.0, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs in the mix of one budget, with all their columns; see mix.

    The thresholds (a row a source) are joined to the documents: Spark broadcasts them while they are below its broadcast limit.

    A null source is a source, a null id counts as ''. Null and empty texts have 0 tokens and are in if their hash is below the threshold. Rows of one id, repeated ones too, are in or out together, so no tie is broken.
    Very long texts count whole. An empty table gives no rows.
    """
    slim = written(docs.select(F.col(source_col).alias("source"), hash60(F.col(id_col)).alias("h"), n_tokens(F.col(text_col)).alias("n_tokens")), "mix-rows")
    source, cut = fresh(docs, "mix_source", "mix_cut")
    cuts = thresholds(slim, (budget,), weights).select(F.col("source").alias(source), F.col("threshold").alias(cut))
    return docs.join(cuts, docs[source_col].eqNullSafe(cuts[source])).where(hash60(docs[id_col]) < F.col(cut)).select(*(docs[c] for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _budget_sql(i: int) -> str:
    return f"floor(all_tokens * {sorted(BUDGETS)[i]!r}::DOUBLE * w / all_w)"


SQL = {
    "op9_mixing": f"""
        WITH rows_ AS (
            SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
                   CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS BIGINT) AS n_tokens
            FROM documents),
        totals AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS has, floor(sqrt(CAST(sum(n_tokens) AS DOUBLE))) AS w FROM rows_ GROUP BY source),
        whole AS (SELECT sum(w) AS all_w, sum(has) AS all_tokens FROM totals),
        placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM rows_)
        SELECT p.doc_id, p.source, p.n_tokens,
               CASE {" ".join(f"WHEN so_far <= {_budget_sql(i)} THEN {b!r}::DOUBLE" for i, b in enumerate(sorted(BUDGETS)))} END AS budget
        FROM placed p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source CROSS JOIN whole
        WHERE so_far <= {_budget_sql(len(BUDGETS) - 1)}
    """
}
QUERIES = {"op9_mixing": op9_mixing}
