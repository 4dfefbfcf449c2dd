"""Streaming queries over the logs, drained over all that is there; the batch form is their twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import jobs
from .base import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("""WITH w AS (SELECT epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) FILTER (WHERE value > 10) AS positive, count(*) FILTER (WHERE NOT value > 10) AS negative FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT start, event_type, positive, negative FROM w""")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily verdict counts of the event stream in complete mode."""
    where = _folder(spark)
    src = jobs.read_log(spark, f"{sf_dir}/events.parquet").where("value is not null").select(F.col("ts").cast("timestamp").alias("at"), "event_type", (F.col("value") > 10).alias("positive"))
    out = jobs.verdict_counts(src, "event_type", "at", "1 day", "1 day")
    jobs.drain(out, where, "complete")
    last = spark.read.parquet(f"{where}/out")
    top = last.agg(F.max("batch").alias("batch"))
    return last.join(F.broadcast(top), "batch").select(F.unix_seconds("start").alias("start"), "event_type", "positive", "negative")


@query("""SELECT DISTINCT chunk_id, track, knowledge_base_id, epoch_us(upserted_at) AS upserted_us FROM vectors WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, track ORDER BY upserted_at DESC) = 1""")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector log merged into a table of latest rows by a stream."""
    where = _folder(spark)
    src = jobs.read_log(spark, f"{sf_dir}/vectors.parquet").where("chunk_id is not null").select("chunk_id", "track", "knowledge_base_id", F.unix_micros("upserted_at").alias("upserted_us"))
    jobs.upsert_stream(src, f"{where}/table", ["chunk_id", "track"], "upserted_us", f"{where}/state").awaitTermination()
    return jobs.current_version(spark, f"{where}/table")


@query("""WITH o AS (SELECT user_id, ts, sum((coalesce(ts - prev > INTERVAL '6 hours', true))::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)),
    g AS (SELECT user_id, s, min(ts) AS a, max(ts) AS b, count(*) AS n FROM o GROUP BY 1, 2)
    SELECT user_id, epoch_us(a) AS start_us, epoch_us(b + INTERVAL '6 hours') AS end_us, n FROM g""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, by the operator that also runs on the stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return jobs.sessions(e, "user_id", "at", "1 day", "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH e AS (SELECT unnest([floor(epoch(ts) / 43200)::BIGINT * 43200, floor(epoch(ts) / 43200)::BIGINT * 43200 - 43200]) AS start, event_type FROM events)
    SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM e GROUP BY 1""")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by sliding windows of a day, twice a day, of the event stream in complete mode."""
    where = _folder(spark)
    src = jobs.read_log(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    jobs.drain(jobs.sliding_failures(src, "at", F.col("event_type") == "error", "1 day", "1 day", "12 hours"), where, "complete")
    last = spark.read.parquet(f"{where}/out")
    top = last.agg(F.max("batch").alias("batch"))
    return last.join(F.broadcast(top), "batch").select(F.unix_seconds("start").alias("start"), "n", "failures")


@query("""WITH l AS (SELECT user_id::VARCHAR AS edge, list(CASE WHEN event_type = 'click' THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END ORDER BY ts, event_id) AS s FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
    SELECT edge, round(list_reduce(list_prepend(1.0::DOUBLE, s), lambda w, x: greatest(0.05::DOUBLE, w + x)), 6) AS weight FROM l""")
def stream_alias_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by keyed state over the event stream, clicks up and errors down; the last weight of each key."""
    where = _folder(spark)
    src = jobs.read_log(spark, f"{sf_dir}/events.parquet", 1000).where("event_type in ('click', 'error')")
    src = src.select(F.col("user_id").cast("string").alias("edge"), (F.col("event_type") == "click").alias("positive"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    jobs.drain(jobs.alias_weights(src, ttl_ms=366 * 24 * 3600 * 1000), where, "update")
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("edge").agg(F.max_by("weight", "batch").alias("weight"))
