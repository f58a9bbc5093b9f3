"""Counter rates, service-level objectives and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cpu_percent(samples: DataFrame) -> DataFrame:
    """Usage between one sample of a container and the next (``container, ts, cpu, system, ncpu, used, memory_limit``)."""
    w = W.partitionBy("container").orderBy("ts")
    cpu, system = (F.col(c) - F.lag(c).over(w) for c in ("cpu", "system"))
    rows = samples.withColumn("_cpu", cpu).withColumn("_system", system)
    percent = F.when((F.col("_cpu") > 0) & (F.col("_system") > 0), F.col("_cpu") / F.col("_system") * F.col("ncpu") * 100).otherwise(0.0)
    memory = F.when(F.col("memory_limit") > 0, F.col("used") / F.col("memory_limit") * 100).otherwise(0.0)
    return rows.withColumn("cpu_percent", percent).withColumn("memory_percent", memory).drop("_cpu", "_system")


def counter_increase(samples: DataFrame) -> DataFrame:
    """``increase`` of a counter since the sample before; after a reset, its value."""
    w = W.partitionBy("entity_id", "metric_name").orderBy("ts", "value")
    before = F.lag("value").over(w)
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def slo_availability(health: DataFrame, target: float = 99.9) -> DataFrame:
    """Share of good checks per entity, and whether it meets the target."""
    share = F.coalesce(F.try_divide(F.count_if("good") * 100.0, F.count("good")), F.lit(0.0))
    return health.groupBy("entity_id").agg(share.alias("availability"), F.count("good").alias("checks")).withColumn("met", F.col("availability") >= target)


def threshold_alerts(metrics: DataFrame, breach: Column, for_seconds: int) -> DataFrame:
    """Spans of a series over which ``breach`` held without a break for at least ``for_seconds``."""
    w = W.partitionBy("entity_id", "metric_name").orderBy("ts", "event_id")
    rows = metrics.withColumn("_bad", F.coalesce(breach, F.lit(False)))
    rows = rows.withColumn("_island", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_bad")
    spans = rows.groupBy("entity_id", "metric_name", "_island").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("points"))
    return spans.where(F.unix_micros("ended") - F.unix_micros("started") >= for_seconds * 1_000_000).drop("_island")


def absence_alerts(metrics: DataFrame, for_seconds: int, now=None) -> DataFrame:
    """Gaps of a series longer than ``for_seconds``: between one point and the next and, with ``now``, between the last point and that time.

    A gap that is still open at ``now`` has no ``until``. Points after ``now`` are left out.
    """
    if now is not None:
        metrics = metrics.where(F.col("ts") <= F.lit(now))
    w = W.partitionBy("entity_id", "metric_name").orderBy("ts", "event_id")
    rows = metrics.withColumn("until", F.lead("ts").over(w))
    end = F.col("until") if now is None else F.coalesce("until", F.lit(now).cast("timestamp"))
    return rows.where(F.unix_micros(end) - F.unix_micros("ts") > for_seconds * 1_000_000).select("entity_id", "metric_name", F.col("ts").alias("since"), "until")


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Quantile of cumulative buckets (``entity_id, le, count``), linear inside the bucket that holds it.

    In the bucket without an upper bound (``le`` infinite) it is that bucket's lower bound, and
    null where there is no other bucket; an entity without a count has none.
    """
    w = W.partitionBy("entity_id").orderBy("le")
    whole = W.partitionBy("entity_id")
    rows = buckets.withColumn("low", F.lag("le").over(w)).withColumn("below", F.coalesce(F.lag("count").over(w), F.lit(0)))
    rows = rows.withColumn("rank", F.max("count").over(whole) * q)
    inside = (F.col("count") >= F.col("rank")) & (F.col("below") < F.col("rank"))
    low = F.coalesce("low", F.lit(0.0))
    value = low + (F.col("le") - low) * (F.col("rank") - F.col("below")) / (F.col("count") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(value)
    return rows.where(inside).select("entity_id", value.alias("quantile"))


def slo_latency(samples: DataFrame, objective_ms: float = 5000.0, since=None) -> DataFrame:
    """p99 latency of each entity (``entity_id, ts, duration_ms``) at or after ``since``, and whether it stays below the objective."""
    rows = samples if since is None else samples.where(F.col("ts") >= since)
    return rows.groupBy("entity_id").agg(F.percentile("duration_ms", F.lit(0.99)).alias("p99"), F.count("duration_ms").alias("samples")).withColumn("met", F.col("p99") < objective_ms)


def counter_rate(samples: DataFrame, seconds: int = 300) -> DataFrame:
    """``rate`` of a counter: its increase over the last ``seconds`` before each sample, per second."""
    w = W.partitionBy("entity_id", "metric_name").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    rows = counter_increase(samples).withColumn("_at", F.unix_micros("ts"))
    return rows.withColumn("rate", F.sum("increase").over(w) / seconds).drop("_at")


def evaluate_alert_rules(metrics: DataFrame, rules: list[dict], now=None) -> DataFrame:
    """``rule, entity_id, metric_name, started, ended``: when a rule held for its whole ``for`` time.

    A rule has ``name``, ``metric``, ``kind`` and ``seconds``. ``equals`` compares values with
    ``limit``; ``absent`` looks for gaps, with ``now`` for those that last until then too (``ended``
    is null); ``rate_zero`` and ``rate_above`` compare the rate of a counter over ``window``
    seconds (300) with 0 and ``limit``; ``quantile_above`` compares the ``quantile`` of the values
    of each ``window`` (300 seconds) with ``limit``.
    """
    found = None
    for rule in rules:
        series = metrics.where(F.col("metric_name") == rule["metric"])
        if rule["kind"] == "absent":
            spans = absence_alerts(series, rule["seconds"], now).select("entity_id", "metric_name", F.col("since").alias("started"), F.col("until").alias("ended"))
        else:
            if rule["kind"] == "equals":
                breach = F.col("value") == rule["limit"]
            elif rule["kind"] == "quantile_above":
                window = F.window("ts", f"{rule.get('window', 300)} seconds")
                series = series.groupBy("entity_id", "metric_name", window.alias("w")).agg(F.percentile("value", F.lit(rule["quantile"])).alias("q"), F.min("event_id").alias("event_id"))
                series = series.withColumn("ts", F.col("w.start"))
                breach = F.col("q") > rule["limit"]
            else:
                series = counter_rate(series, rule.get("window", 300))
                breach = F.col("rate") == 0 if rule["kind"] == "rate_zero" else F.col("rate") > rule["limit"]
            spans = threshold_alerts(series, breach, rule["seconds"]).select("entity_id", "metric_name", "started", "ended")
        spans = spans.select(F.lit(rule["name"]).alias("rule"), "*")
        found = spans if found is None else found.unionByName(spans)
    if found is None:
        raise ValueError("no rules")
    return found
