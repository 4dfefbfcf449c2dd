"""Sinks: partitioned Parquet tables with keyed writes, and JSON artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog


def table_path(base: str, *parts: str) -> str:
    """A folder for a scope; characters that paths do not like become hyphens."""
    return "/".join([base.rstrip("/"), *(p.replace(":", "-").replace("/", "-") for p in parts)])


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 2_000_000) -> None:
    """A table in folders by tenant and scope, so filters on them prune files; one shuffle, which splits large partitions."""
    n = [F.col(c) for c in by]
    df.repartition(*n, F.spark_partition_id() % 8).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def merge_into(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: str, by: list[str]) -> None:
    """Rewrites only the partitions that `changes` touch; of the rows of a key the latest stays.

    The merged rows are written beside the table, under a name of this run, before they replace anything; a run that fails leaves the table as it was.
    """
    old = spark.read.parquet(path).join(changes.select(*by).distinct(), by, "left_semi")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    catalog.upsert(old, changes, keys, order).write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    drop_folder(spark, staged)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_artifacts(df: DataFrame, path: str, by: list[str]) -> None:
    """Rows as JSON lines in folders by scope."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Artifacts written before, in a schema that is told, not guessed; an absent folder gives no rows."""
    return spark.read.schema(schema).json(path) if folder_exists(spark, path) else spark.createDataFrame([], schema)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def usable_artifacts(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The documents whose cached chunks and vectors are both there: what need not be processed again."""
    return chunks.select(key).distinct().join(vectors.select(key).distinct(), key, "left_semi")


def missing_rows(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The wanted rows that the cache lacks, each once."""
    return wanted.dropDuplicates([key]).join(cached.select(key), key, "left_anti")


def align_cached(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The wanted rows with their cached columns; a wanted row that the cache lacks fails the job, as a silent gap would be worse."""
    have = cached.dropDuplicates([key]).withColumn("_have", F.lit(True))
    both = wanted.join(have, key, "left")
    return both.withColumn("_have", F.when(F.col("_have").isNull(), F.raise_error(F.concat(F.lit("not cached: "), F.col(key).cast("string")))).otherwise(F.col("_have"))).where("_have").drop("_have")
