"""The alias index: weighted edges from an alias to the chunks it stands for, query expansion, and learning from feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft

UP, DOWN, FLOOR = 0.2, -0.3, 0.05


def alias_edges(df: DataFrame, scope: list[str], key: str, aliases: str) -> DataFrame:
    """(scope, `key`, alias, weight): the alias at place r weighs max(0.1, 1 - r / 10); the largest weight of an edge counts."""
    each = df.select(*scope, key, F.posexplode(F.filter(F.transform(aliases, lambda a: F.lower(F.trim(a))), lambda a: a != "")).alias("place", "alias"))
    weight = F.greatest(F.lit(0.1), 1 - 0.1 * F.col("place"))
    return each.groupBy(*scope, key, "alias").agg(F.round(F.max(weight), 6).alias("weight"))


def expand_queries(queries: DataFrame, edges: DataFrame, query: str, text: str, scope: list[str], limit: int) -> DataFrame:
    """(`query`, scope, alias, score, rank): aliases that contain a token of the query, by their summed weight.

    Aliases are cut into all their substrings of a query token's form only once for each distinct alias, so the join is on equality
    of tokens with alias words first; containment in the middle of a word is checked against the distinct aliases.
    """
    tokens = queries.select(query, F.explode(F.array_distinct(ft.query_tokens(F.col(text)))).alias("token"))
    scores = edges.groupBy(*scope, "alias").agg(F.sum("weight").alias("score"))
    names = scores.select("alias").distinct()
    # Every run of three characters of an alias is a key; a token can only stand in an alias that has the token's first run.
    grams = names.select("alias", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("alias") - 2)), lambda i: F.substr("alias", i, F.lit(3))))).alias("gram"))
    hits = tokens.withColumn("gram", F.left("token", F.lit(3))).join(grams, "gram").where(F.contains("alias", F.col("token"))).select(query, "alias").distinct()
    found = hits.join(scores, "alias").withColumn("score", F.round("score", 6))
    w = Window.partitionBy(query).orderBy(F.desc("score"), "alias", *scope)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(query, *scope, "alias", "score", "rank")


def learn_aliases(edges: DataFrame, events: DataFrame, key: str, slice_by: str = "hour") -> DataFrame:
    """(`key`, alias, weight): edges after feedback `events` (query_text, `key`, positive, event_id, at), in the order of time.

    An event moves an edge of its chunk if a query token is a word of the alias: up 0.2 or down 0.3, never below 0.05. The floor makes the
    order matter: the result is the larger of weight + (sum of all steps) and floor + (sum of all steps) - (least running sum). Running sums
    compose, so they are taken within slices of time and then over the slices of an edge; no edge's events are ever held together. Events without a time come first.
    """
    e = events.select(key, F.when(F.col("positive"), UP).otherwise(DOWN).alias("step"), "at", "event_id", ft.query_tokens(F.col("query_text")).alias("tokens"))
    hit = edges.select(key, "alias").join(e, key).where(F.arrays_overlap(F.split("alias", r"\s+"), "tokens")).withColumn("slice", F.date_trunc(slice_by, "at"))
    part = Window.partitionBy(key, "alias", "slice").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    slices = hit.withColumn("run", F.sum("step").over(part)).groupBy(key, "alias", "slice").agg(F.sum("step").alias("sum"), F.min("run").alias("least"))
    before = Window.partitionBy(key, "alias").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = slices.withColumn("least", F.col("least") + F.coalesce(F.sum("sum").over(before), F.lit(0.0))).groupBy(key, "alias").agg(F.sum("sum").alias("sum"), F.min("least").alias("least"))
    both = edges.join(whole, [key, "alias"], "left")
    w = F.col("weight").cast("double")
    learned = F.when(F.col("sum").isNull(), w).otherwise(F.greatest(w + F.col("sum"), F.lit(FLOOR) + F.col("sum") - F.col("least")))
    return both.select(key, "alias", F.round(learned, 6).alias("weight"))
