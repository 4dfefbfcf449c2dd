"""Semantic structure of a document from the vectors of its pieces in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as fv


def adjacent_similarity(df: DataFrame, doc: str, item: str, order: list[str], vector: str, boundary: float = 0.3) -> DataFrame:
    """(doc, item, sim_prev, sim_next, is_boundary, group_id): similarity to the neighbours in order; a topic ends where the next is less similar than `boundary`."""
    w = Window.partitionBy(doc).orderBy(*order)
    v = F.col(vector)
    near = df.withColumn("_p", F.lag(v).over(w)).withColumn("_n", F.lead(v).over(w))
    sims = near.withColumn("sim_prev", F.round(fv.cosine(v, F.col("_p")), 6)).withColumn("sim_next", F.round(fv.cosine(v, F.col("_n")), 6))
    ends = sims.withColumn("is_boundary", F.coalesce(F.col("sim_next") < boundary, F.lit(False)))
    group = F.coalesce(F.sum(F.col("is_boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("group_id", group.cast("int")).select(doc, item, "sim_prev", "sim_next", "is_boundary", "group_id")


def document_neighbours(df: DataFrame, doc: str, item: str, place: str, vector: str, least: float = 0.5, k: int = 5) -> DataFrame:
    """(doc, item, neighbour, score, rank): the `k` most similar pieces of the same document, not the adjacent ones, from `least` up.

    Documents have a bounded number of pieces, so the join within a document is bounded too.
    """
    a = df.select(doc, F.col(item).alias("a"), F.col(place).alias("pa"), F.col(vector).alias("va"))
    b = df.select(doc, F.col(item).alias("b"), F.col(place).alias("pb"), F.col(vector).alias("vb"))
    s = a.join(b, doc).where(F.abs(F.col("pa") - F.col("pb")) > 1).withColumn("score", F.round(fv.cosine(F.col("va"), F.col("vb")), 6)).where(F.col("score") >= least)
    w = Window.partitionBy(doc, "a").orderBy(F.desc("score"), "b")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(doc, F.col("a").alias(item), F.col("b").alias("neighbour"), "score", "rank")
