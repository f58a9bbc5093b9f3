"""Windowed features per entity and metric. The same code runs on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = ["entity_id", "metric_name"]


def tumbling_features(metrics: DataFrame, size: str = "5 minutes") -> DataFrame:
    grouped = metrics.groupBy(*KEYS, F.window("ts", size).alias("w"))
    out = grouped.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.count("value").alias("count"), F.sum("value").alias("sum"), F.count_if("is_error").alias("errors"))
    return out.select(*KEYS, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(size).alias("window_size"), "min", "max", "avg", "count", "sum", (F.col("errors") / F.col("count")).alias("error_rate"))


def sliding_features(metrics: DataFrame, size: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    grouped = metrics.groupBy(*KEYS, F.window("ts", size, slide).alias("w"))
    out = grouped.agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.count("value").alias("count"),
        *[F.percentile("value", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.stddev_pop("value").alias("stddev"),
    )
    return out.select(*KEYS, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(size).alias("window_size"), "min", "max", "avg", "count", "p50", "p95", "p99", "stddev", (F.col("count") / seconds).alias("rate"))


def sliding_by_panes(metrics: DataFrame, size: str = "5 minutes", slide: str = "1 minute", seconds: int = 300, k: int = 800) -> DataFrame:
    """``sliding_features`` with each value read into one pane of ``slide``, and the panes merged into the windows that hold them.

    A value goes into one row instead of into one for each window. Percentiles come from mergeable
    sketches: a percentile is a value whose rank is within about 0.4 % (k = 800) of the one
    asked for, and exact (the smallest value of at least that rank) for windows of ``k`` values or fewer.
    """
    quantiles = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    panes = metrics.groupBy(*KEYS, F.window("ts", slide).alias("pane")).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("value").alias("n"), (F.var_pop("value") * F.count("value")).alias("m2"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
    )
    merged = panes.withColumn("at", F.window_time("pane")).groupBy(*KEYS, F.window("at", size, slide).alias("w")).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("count"), F.kll_merge_agg_double("sketch").alias("sketch"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("panes"),  # as many as a window has panes
    )
    zero = F.lit(0.0)
    merged = merged.withColumn("avg", F.try_divide(F.aggregate("panes", zero, lambda a, x: a + F.coalesce(x["n"] * x["mean"], zero)), F.col("count")))
    spread = F.aggregate("panes", zero, lambda a, x: a + F.coalesce(x["m2"] + x["n"] * F.pow(x["mean"] - F.col("avg"), F.lit(2)), zero))
    found = F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, quantiles.values()))))
    merged = merged.withColumn("found", found)
    return merged.select(
        *KEYS, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(size).alias("window_size"), "min", "max", "avg", "count",
        *[F.get("found", F.lit(i)).alias(n) for i, n in enumerate(quantiles)], F.sqrt(F.try_divide(spread, F.col("count"))).alias("stddev"), (F.col("count") / seconds).alias("rate"),
    )


def session_bursts(metrics: DataFrame, gap: str = "30 seconds", threshold: int = 3) -> DataFrame:
    """Sessions of an entity that a gap ends; a burst has more errors than the threshold."""
    out = metrics.groupBy("entity_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if("is_error").alias("errors"))
    return out.select("entity_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "errors", (F.col("errors") > threshold).alias("burst"))


def feature_vectors(windowed: DataFrame) -> DataFrame:
    """Running merge of the windows of an entity and size: count-weighted mean, extremes, volume, the
    latest percentiles (null where windows have none) and error rate. The version counts the
    merges of the entity. Windows of 5 minutes should come from ``sliding_features``, which have percentiles.
    """
    order = ("window_end", "window_start", "metric_name")
    w = W.partitionBy("entity_id", "window_size").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    of_entity = W.partitionBy("entity_id").orderBy(*order, "window_size").rowsBetween(W.unboundedPreceding, 0)
    given = lambda c: F.last(c, ignorenulls=True).over(w) if c in windowed.columns else F.lit(None).cast("double")
    return windowed.select(
        "entity_id", "window_size", "metric_name", "window_end", F.min("window_start").over(w).alias("first_start"),
        *[given(c).alias(f"latency_{c}") for c in ("p50", "p95", "p99")], given("error_rate").alias("error_rate"),
        (F.sum(F.col("avg") * F.col("count")).over(w) / F.sum("count").over(w)).alias("latency_avg"),
        F.min("min").over(w).alias("latency_min"), F.max("max").over(w).alias("latency_max"), F.sum("count").over(w).alias("request_volume"),
        F.count(F.lit(1)).over(of_entity).alias("feature_version"), F.lit(90).alias("ttl"),
    )


def metrics_baseline(metrics: DataFrame, start=None, end=None) -> DataFrame:
    """Statistics of each series, of its points from ``start`` to ``end``, both included."""
    if start is not None:
        metrics = metrics.where(F.col("ts") >= start)
    if end is not None:
        metrics = metrics.where(F.col("ts") <= end)
    return metrics.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"), F.percentile("value", F.lit(0.95)).alias("p95"), F.count("value").alias("count"))


def baseline_of(metrics: DataFrame, entity_id: str, metric_name: str, start=None, end=None) -> DataFrame:
    """The baseline of one series as one row; zeros where it has no points."""
    rows = metrics.where((F.col("entity_id") == entity_id) & (F.col("metric_name") == metric_name))
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    zero = F.lit(0.0)
    return rows.agg(F.coalesce(F.avg("value"), zero).alias("mean"), F.coalesce(F.stddev_samp("value"), zero).alias("stddev"), F.coalesce(F.percentile("value", F.lit(0.95)), zero).alias("p95"), F.count("value").alias("count"))


def list_entities(features: DataFrame) -> DataFrame:
    return features.select("entity_id").where("entity_id is not null").distinct()


def hourly_timeseries(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(*KEYS, F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"))
