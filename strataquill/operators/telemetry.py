"""Latency and counter summaries of event logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds in seconds of latency buckets (fixed values).
SEARCH_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


#: Bins of one group's values; an exact order statistic sorts the values of the bins it falls in, no others.
BINS = 1024


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, n, lowest, highest, total, v0, v1, ...): the values at `ranks(n)`, counted from 0, of each group's sorted values; nulls and NaN do not count.

    Exact and without a group in one place: a histogram of each group tells which bin holds a rank, and only the distinct values of those
    bins, counted, are sorted. Groups are equal by value, null being one.
    """
    v = F.col(value).cast("double")
    src = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    keys = [f"_k{i}" for i in range(len(by))]
    src = src.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "_v")
    stats = src.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"), F.sum("_v").alias("total"))
    width = F.col("highest") / 2 - F.col("lowest") / 2  # halves, lest the largest doubles overflow
    bin_of = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lowest") / 2) / width * BINS))).otherwise(0)
    placed = _join(src, stats.select(*keys, "lowest", "highest"), keys).select(*keys, "_v", bin_of.cast("int").alias("_bin"))
    before = lambda by, order: F.sum("_c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    bins = placed.groupBy(*keys, "_bin").agg(F.count("*").alias("_c")).withColumn("_before", before(keys, "_bin"))
    wanted = stats.select(*keys, F.posexplode(F.array(*(r.cast("bigint") for r in ranks(F.col("n"))))).alias("_i", "_r"))
    hit = _join(bins, wanted, keys).where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c"))).select(*keys, "_bin", "_before", "_i", "_r")
    some = hit.select(*keys, "_bin", "_before").distinct()
    values = _join(placed, some, [*keys, "_bin"]).groupBy(*keys, "_bin", "_before", "_v").agg(F.count("*").alias("_c"))
    values = values.withColumn("_upto", F.col("_before") + before([*keys, "_bin"], "_v")).drop("_before")
    found = _join(hit, values, [*keys, "_bin"]).where((F.col("_r") >= F.col("_upto")) & (F.col("_r") < F.col("_upto") + F.col("_c")))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"v{i}") for i in range(len(ranks(F.lit(1))))))
    return _join(stats, wide, keys).withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on equal columns, null being equal to null."""
    named = right.withColumnsRenamed({c: f"{c}_right" for c in on})
    return left.join(named, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_right")) for c in on), F.lit(True))).drop(*(f"{c}_right" for c in on))


def _between(p: float) -> tuple[Callable[[Column], list[Column]], Callable[[str, str], Column]]:
    """The two ranks around the percentile `p`, and the value between theirs."""
    at = lambda n: (n - 1) * F.lit(p)
    return lambda n: [F.floor(at(n)), F.ceil(at(n))], lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (at(F.col("n")) - F.floor(at(F.col("n"))))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, 95th percentile (linear between ranks) and maximum; nulls do not count."""
    (mid, mid_value), (high, high_value) = _between(0.5), _between(0.95)
    s = order_statistics(df, by, value, lambda n: [*mid(n), *high(n)])
    return s.select(*by, "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round(mid_value("v0", "v1"), 6).alias("p50"), F.round(high_value("v2", "v3"), 6).alias("p95"), F.col("highest").alias("max"))


def rank_p95(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, p95): the value at place floor(0.95 (n - 1)) of the sorted values, without interpolation."""
    s = order_statistics(df, by, value, lambda n: [F.floor((n - 1) * F.lit(0.95))])
    return s.select(*by, "n", F.col("v0").alias("p95"))


def truncated_p95(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, p95): the value at place max(floor(0.95 n) - 1, 0) of the sorted values."""
    s = order_statistics(df, by, value, lambda n: [F.greatest(F.floor(n * F.lit(0.95)) - 1, F.lit(0))])
    return s.select(*by, "n", F.col("v0").alias("p95"))


def histogram(df: DataFrame, by: list[str], seconds: Column, buckets: tuple[float, ...] = SEARCH_BUCKETS) -> DataFrame:
    """(by, le, n): cumulative counts by bucket bound, the last unbounded ("+Inf"), in one pass."""
    names = [str(b) for b in buckets] + ["+Inf"]
    counts = df.where(seconds.isNotNull()).groupBy(*by).agg(*(F.count_if(seconds <= b).alias(f"_{i}") for i, b in enumerate(buckets)), F.count("*").alias(f"_{len(buckets)}"))
    pairs = F.array(*(F.struct(F.lit(n).alias("le"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)))
    return counts.select(*by, F.inline(pairs))


def alert_windows(df: DataFrame, at: str, value: str, width: str, most: float) -> DataFrame:
    """(start, n, p95): windows of `width` whose 95th percentile is over `most`."""
    ranks, between = _between(0.95)
    w = order_statistics(df.select(F.window(at, width)["start"].alias("start"), value), ["start"], value, ranks)
    return w.select("start", "n", F.round(between("v0", "v1"), 6).alias("p95")).where(F.col("p95") > most)


def error_windows(df: DataFrame, at: str, failed: Column, width: str, most: float) -> DataFrame:
    """(start, n, failures, rate): windows of `width` with a failure rate over `most`."""
    w = df.groupBy(F.window(at, width)).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return w.withColumn("rate", F.round(F.col("failures") / F.col("n"), 6)).where(F.col("rate") > most).select(F.col("window.start").alias("start"), "n", "failures", "rate")
