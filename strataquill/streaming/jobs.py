"""Streams that keep views of event logs up to date.

Each function takes a streaming DataFrame (and works on a batch one too). State is bounded by a watermark where time allows it; what is
kept for ever is one small row for each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog

UP, DOWN, FLOOR = 0.2, -0.3, 0.05


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    # As a pattern, for the file source takes a plain path for a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def once_each(df: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows of a key once, as far apart as `late` in event time."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def verdict_counts(df: DataFrame, by: str, at: str, late: str, width: str) -> DataFrame:
    """(start, by, positive, negative) by window of event time; rows later than `late` are left out."""
    w = df.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))
    return w.select(F.col("window.start").alias("start"), by, "positive", "negative")


def sliding_failures(df: DataFrame, at: str, failed: Column, late: str, width: str, slide: str) -> DataFrame:
    """(start, n, failures) by sliding window."""
    w = df.withWatermark(at, late).groupBy(F.window(at, width, slide)).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return w.select(F.col("window.start").alias("start"), "n", "failures")


def sessions(df: DataFrame, user: str, at: str, late: str, gap: str) -> DataFrame:
    """(user, start, end, n) of runs of events no more than `gap` apart."""
    w = df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return w.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def alias_weights(events: DataFrame, start: float = 1.0, ttl_ms: int = 7 * 24 * 3600 * 1000, late: str = "1 day") -> DataFrame:
    """(edge, weight) after each batch of `events` (edge, positive, at, event_id), folded in order of time, then of event_id, with a floor.

    The state of an edge is its weight; it is dropped when the watermark is `ttl_ms` past its last event.
    """

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weight = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        for good in rows["positive"]:
            weight = max(FLOOR, weight + (UP if good else DOWN))
        state.update((weight,))
        last = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"edge": [key[0]], "weight": [round(weight, 6)]})

    return events.select("edge", "positive", "at", "event_id").withWatermark("at", late).groupBy("edge").applyInPandasWithState(fold, "edge string, weight double", "weight double", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(df: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """A streaming query that keeps the latest row of each key in the Parquet table `path`.

    The table lies in `buckets` by the hash of the key; a batch rewrites those it touches, under a name of its own, and then lists where each bucket lies. Readers
    see whole lists only, a batch that runs twice gives the same table, and files that neither the last list nor the one before names are removed.
    """
    spark = df.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        spread = rows.persist()
        try:
            touched = [r[0] for r in spread.select("_bucket").distinct().collect()]  # `buckets` numbers at most
            if not touched:
                return
            last = _places(spark, path)
            old = [last[i] for i in touched if i in last]
            merged = spread.drop("_bucket")
            if old:
                merged = spark.read.parquet(*old).unionByName(merged, allowMissingColumns=True)
            version = f"{path}/data/{number}-{uuid.uuid4().hex}"
            latest = catalog.latest(merged, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            latest.write.partitionBy("_bucket").parquet(version)
        finally:
            spread.unpersist()
        now = last | {i: f"{version}/_bucket={i}" for i in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, place string").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/{number}")
        _sweep(spark, path, set(last.values()) | set(now.values()))

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert_stream` keeps."""
    return spark.read.parquet(*_places(spark, path).values())


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [f.getPath().toString() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []


def _places(spark: SparkSession, path: str) -> dict[int, str]:
    """Where each bucket lies, by the last list that is complete."""
    lists = [p for p in _folders(spark, f"{path}/lists") if _exists(spark, f"{p}/_SUCCESS")]
    if not lists:
        return {}
    last = max(lists, key=lambda p: int(p.rsplit("/", 1)[-1]))
    return {r["bucket"]: r["place"] for r in spark.read.parquet(last).collect()}


def _sweep(spark: SparkSession, path: str, named: set[str]) -> None:
    """Removes the versions of buckets that no list in use names, and lists but the last two."""
    used = {p.split("/data/", 1)[1] for p in named}
    for version in _folders(spark, f"{path}/data"):
        for bucket in _folders(spark, version):
            if bucket.split("/data/", 1)[1] not in used:
                fs, where = _fs(spark, bucket)
                fs.delete(where, True)
    for old in sorted(_folders(spark, f"{path}/lists"), key=lambda p: int(p.rsplit("/", 1)[-1]))[:-2]:
        fs, where = _fs(spark, old)
        fs.delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drain(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and writes what it emits under `folder`."""
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
