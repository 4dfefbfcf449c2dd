"""Catalog tables: latest rows, upserts, merged keywords, change detection, expansion of bulk requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first by `order` descending, nulls last; equal rows are one."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(o) for o in order))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """`current` with `changes`: of the rows of a key the latest stays."""
    return latest(current.unionByName(changes, allowMissingColumns=True), keys, *order)


def merge_keywords(df: DataFrame, key: str, keywords: str, order: str, most: int = 50) -> DataFrame:
    """(`key`, keywords): distinct keywords regardless of case in the order they came, in the casing that came first, `most` at most."""
    each = df.select(key, F.col(order).alias("_o"), F.posexplode(keywords).alias("_p", "_w")).withColumn("_w", F.trim("_w")).where("_w <> ''")
    first = each.groupBy(key, F.lower("_w").alias("_low")).agg(F.min(F.struct("_o", "_p", "_w")).alias("_f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_f._o", "_f._p", "_low"))
    top = first.withColumn("_n", place).where(F.col("_n") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("_f._w").alias("w")))), lambda s: s["w"]).alias("keywords"))


def frequent_keywords(df: DataFrame, key: str, keywords: str, order: list[str], most: int = 50) -> DataFrame:
    """(`key`, keywords): the `most` frequent keywords regardless of case, ties by where they came first (in `order`), in the casing that came first."""
    each = df.select(key, F.struct(*order).alias("_o"), F.posexplode(keywords).alias("_p", "_w")).withColumn("_w", F.trim("_w")).where("_w <> ''")
    counts = each.groupBy(key, F.lower("_w").alias("_low")).agg(F.count("*").alias("_c"), F.min(F.struct("_o", "_p", "_w")).alias("_f"))
    w = Window.partitionBy(key).orderBy(F.desc("_c"), "_f._o", "_f._p", "_low")
    top = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("_f._w").alias("w")))), lambda s: s["w"]).alias("keywords"))


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(`key`, change): `new`, `updated`, `deleted` or `same` by the hash of the content; null content is content of its own."""
    h = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col(content)), F.lit("n")), 256)
    a, b = old.select(key, h.alias("_a")), new.select(key, h.alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "same").otherwise("updated")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def expand_bulk(df: DataFrame, key: str, uris: str) -> DataFrame:
    """One row for each URI of a request, its key with the suffix -1, -2 and so on."""
    each = df.select("*", F.posexplode(uris).alias("_p", "uri"))
    return each.withColumn(key, F.concat(F.col(key), F.lit("-"), (F.col("_p") + 1).cast("string"))).drop("_p", uris)
