"""The platform's tables in the shape the operators take: current rows, resolved knowledge bases, one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def current_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, kb, source_type, lang, title) of each document's latest submission."""
    s = table(spark, sf_dir, "submissions").select(
        "document_id", F.col("knowledge_base_id").alias("kb"), "source_type", F.try_element_at("metadata", F.lit("lang")).alias("lang"), F.col("document_title").alias("title"), "submitted_at",
    )
    w = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("submitted_at"), F.desc(F.xxhash64("kb", "source_type", "lang", "title")))
    return s.where("document_id is not null").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "submitted_at")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_id; rows of one chunk_id have the same content."""
    return chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kb, domain), the domain in lower case, `unknown` for null and blank."""
    d = F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("unknown"))
    return table(spark, sf_dir, "knowledge_bases").select(F.col("knowledge_base_id").alias("kb"), d.alias("domain")).dropDuplicates(["kb"])
