"""Feedback as views over an append-only log.

Defined results: a feedback_id counts once (its latest arrival); rows without chunks count with weight 1 in totals and for no chunk; null verdicts are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft


def current_feedback(log: DataFrame) -> DataFrame:
    """One row for each feedback_id, the one that arrived last."""
    w = Window.partitionBy("feedback_id").orderBy(F.desc_nulls_last("received_at"), F.desc_nulls_last("given_at"), F.xxhash64("query_text", "comment_text", "positive"))
    return log.where("feedback_id is not null and positive is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def verdicts(df: DataFrame, by: list[str], weight=None) -> DataFrame:
    """Positive and negative counts, their ratio and difference, the latest time and the latest comment, by key.

    All parts are plain aggregates, so a key with most of the rows is summed before the shuffle.
    """
    n = F.lit(1) if weight is None else weight
    said = F.nullif(F.trim("comment_text"), F.lit(""))
    out = df.groupBy(*by).agg(
        F.sum(F.when(F.col("positive"), n).otherwise(0)).cast("bigint").alias("positive"),
        F.sum(F.when(~F.col("positive"), n).otherwise(0)).cast("bigint").alias("negative"),
        F.max("given_at").alias("last_at"),
        F.max(F.when(said.isNotNull(), F.struct("given_at", "feedback_id", said.alias("c"))))["c"].alias("last_comment"),
    )
    total = F.col("positive") + F.col("negative")
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide("positive", total), F.lit(0.0)), 6)).withColumn("score", F.col("positive") - F.col("negative"))


def by_query(log: DataFrame) -> DataFrame:
    """Verdicts by normalised query."""
    return verdicts(current_feedback(log).withColumn("query", ft.query_key(F.col("query_text"))).where("query <> ''"), ["query"])


def by_chunk(log: DataFrame) -> DataFrame:
    """Verdicts by chunk; a chunk named twice in one row counts once."""
    each = current_feedback(log).select("feedback_id", "positive", "comment_text", "given_at", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).where("chunk_id is not null")
    return verdicts(each, ["chunk_id"])


def totals(log: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts by other columns, each row weighing as many as it has chunks, one at least."""
    return verdicts(current_feedback(log), by, F.greatest(F.lit(1), F.size(F.coalesce("chunk_ids", F.array()))))


def repeat_downvotes(log: DataFrame, least: int = 2) -> DataFrame:
    """(chunk_id, positive, negative): chunks voted down `least` times or more and more often than up, to be chunked again or reviewed."""
    return by_chunk(log).where((F.col("negative") >= least) & (F.col("negative") > F.col("positive"))).select("chunk_id", "positive", "negative")


def precision_at_k(judged: DataFrame, sizes: DataFrame, query: str, k: int) -> DataFrame:
    """(`query`, precision, recall) of ranked lists with a `hit` for each row; `sizes` has (`query`, all): how many items are relevant, counted, never paired."""
    hits = judged.where(F.col("rank") <= k).groupBy(query).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    return hits.join(sizes.select(query, "all"), query, "left").select(query, F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "all"), F.lit(0.0)), 6).alias("recall"))
