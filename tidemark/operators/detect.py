"""Anomaly detection on metric series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import sigmoid
from ..rules import METRIC_RULES
from ..sources.lineage import cut

SERIES = ["entity_id", "metric_name"]


def zscore_baselines(metrics: DataFrame, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    std = F.stddev_samp("value")
    return metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))


def zscore_score(metrics: DataFrame, baselines: DataFrame, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Sigmoid of the distance from the baseline; a baseline row per metric is few, so Spark may broadcast it."""
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    joined = metrics.join(baselines, list(by)).withColumn("z", z)
    return joined.withColumn("score", _finite(F.col("value"), sigmoid(F.col("z")))).withColumn("deviation", F.col("z") - 3)


def _finite(value: Column, score: Column) -> Column:
    """``score``, or 0 where the value is null, NaN or infinite."""
    odd = F.isnan(value) | F.abs(value).isin(float("inf"))
    return F.when(odd, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def seasonal_naive_score(metrics: DataFrame, history: DataFrame, least_rows: int = 24) -> DataFrame:
    """Distance from the last value of the metric's history as a score; null with fewer than ``least_rows`` values."""
    std = F.stddev_samp("value")
    order = F.struct("ts", "event_id")
    last = history.groupBy("metric_name").agg(F.max_by("value", order).alias("_last"), F.when(std > 0, std).otherwise(1.0).alias("_std"), F.count("value").alias("_rows"))
    joined = metrics.join(last.where(F.col("_rows") >= least_rows), "metric_name", "left")
    z = F.abs(F.col("value") - F.col("_last")) / F.col("_std")
    score = F.when(F.col("_last").isNotNull(), _finite(F.col("value"), sigmoid(z)))
    return joined.withColumn("seasonal_score", score).drop("_last", "_std", "_rows")


def metric_rules(features: DataFrame, baselines: DataFrame, rules: list[tuple[str, str, float]] = METRIC_RULES) -> DataFrame:
    """Rows that break the rule of their metric: a z-score, a value above a limit, or below a share of the baseline's mean."""
    table = features.sparkSession.createDataFrame(rules, "metric_name string, rule string, rule_limit double")
    rows = features.join(F.broadcast(table), "metric_name").join(baselines, "metric_name", "left")
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    broken = (
        F.when(F.col("rule") == "zscore", z >= F.col("rule_limit"))
        .when(F.col("rule") == "above", F.col("value") > F.col("rule_limit"))
        .when(F.col("rule") == "below_share", F.col("value") < F.col("rule_limit") * F.col("mean"))
    )
    return rows.where(broken).drop("mean", "std")


def adaptive_threshold(metrics: DataFrame, k: float = 3.0) -> DataFrame:
    """mean + k population deviations of all earlier values of the series; null before two."""
    w = W.partitionBy(*SERIES).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    limit = F.avg("value").over(w) + k * F.stddev_pop("value").over(w)
    return metrics.withColumn("threshold", F.when(F.count("value").over(w) >= 2, limit)).withColumn("exceeds", F.col("value") > F.col("threshold"))


def cusum_drift(metrics: DataFrame, baselines: DataFrame, slack: float = 0.5, limit: float = 4.0, block: int = 1_000_000) -> DataFrame:
    """Two-sided CUSUM: ``s_pos`` and ``s_neg`` after each value, and ``drift``, whether one is above ``limit``.

    A sum is the running sum of its series less the smallest so far (``_cusum``). Series of
    more than ``block`` values are cut into pieces of time that many tasks handle: a piece is
    the map S -> max(S + total, total - least) of the sum before it, so the pieces' totals and
    least prefixes give the sum that each piece starts with, and only that is carried over.

    Without a spread every step off the mean is infinite: the sum in the direction of the last
    such step is, the other one is 0. Null values change nothing.
    """
    gap = F.col("value") - F.col("mean")
    flat = ~(F.col("std") > 0)
    rows = metrics.join(baselines, "metric_name").select("event_id", *SERIES, "ts", F.when(~flat, gap / F.col("std")).alias("dev"), F.when(flat & (gap != 0), F.signum(gap)).alias("off"))
    large = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*SERIES)
    if large.isEmpty():
        found = _cusum(rows, SERIES, slack)
    else:
        large = F.broadcast(large)  # every one of them has more than block rows
        found = _cusum(rows.join(large, SERIES, "left_anti"), SERIES, slack).unionByName(_cusum_by_pieces(rows.join(large, SERIES, "left_semi"), slack))
    inf = F.lit(float("inf"))
    signed = lambda s, sign: F.when(F.col("off").isNotNull(), F.when(F.col("off") == sign, inf).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0))))
    found = found.select("event_id", *SERIES, signed(F.col("up") - F.least(F.lit(0.0), "up_in", "up_least"), 1.0).alias("s_pos"), signed(F.col("down") - F.least(F.lit(0.0), "down_in", "down_least"), -1.0).alias("s_neg"))
    return found.withColumn("drift", (F.col("s_pos") > limit) | (F.col("s_neg") > limit))


def _cusum(rows: DataFrame, by: list[str], slack: float) -> DataFrame:
    """``rows`` with running sums and their least values (``up``, ``up_least``, ``down``, ``down_least``) and the last ``off``, under ``by``; ``up_in`` and ``down_in`` are 0."""
    w = W.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"up": F.sum(F.col("dev") - slack).over(w), "down": F.sum(-F.col("dev") - slack).over(w), "off": F.last("off", ignorenulls=True).over(w)})
    rows = rows.withColumns({f"{c}_least": F.min(c).over(w) for c in ("up", "down")})
    return rows.select("event_id", *by, "ts", "up", "up_least", "down", "down_least", "off", F.lit(0.0).alias("up_in"), F.lit(0.0).alias("down_in"))


def _cusum_by_pieces(rows: DataFrame, slack: float) -> DataFrame:
    """As ``_cusum``, with series cut by a range partitioning of time; ``up_in`` and ``down_in`` are the sums before a piece, negated."""
    order = [*SERIES, "ts", "event_id"]
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut_rows = cut(rows.repartitionByRange(int(parts), *order).withColumn("piece", F.spark_partition_id()))
    local = cut(_cusum(cut_rows, [*SERIES, "piece"], slack).drop("up_in", "down_in"))
    newest = F.struct("ts", "event_id")
    pieces = local.groupBy(*SERIES, "piece").agg(*[F.max_by(c, newest).alias(c) for c in ("up", "down", "off")], *[F.min(c).alias(c) for c in ("up_least", "down_least")])
    w = W.partitionBy(*SERIES).orderBy("piece")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    total = {c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("up", "down")}
    pieces = pieces.withColumns({f"{c}_sum": total[c] for c in total})
    carried = {f"{c}_in": F.least(F.lit(0.0), F.min(F.col(f"{c}_sum") + F.col(f"{c}_least")).over(before)) - F.col(f"{c}_sum") for c in total}
    pieces = pieces.withColumns(carried).withColumn("off_in", F.last("off", ignorenulls=True).over(before)).select(*SERIES, "piece", "up_in", "down_in", "off_in")
    found = local.join(pieces, [*SERIES, "piece"]).withColumn("off", F.coalesce("off", "off_in"))
    # Where a piece has had null values only, its sums are those before it.
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("up", "down", "up_least", "down_least")}
    return found.withColumns(zero).drop("piece", "off_in")


def suppress_noise(signals: DataFrame, seconds: int = 180, strong: float = 0.85, neighbors: int = 3) -> DataFrame:
    """Weak signals are kept once ``seconds`` have passed since the series was first seen; strong ones always,
    and so are those of security (``source_type``) and those with ``affected_neighbors`` around, where these columns are there."""
    first = signals.groupBy(*SERIES).agg(F.min("ts").alias("_first"))
    age = F.unix_micros("ts") - F.unix_micros("_first")
    keep = (F.col("score") >= strong) | (age >= seconds * 1_000_000)
    if "source_type" in signals.columns:
        keep = keep | F.coalesce(F.col("source_type") == "security", F.lit(False))
    if "affected_neighbors" in signals.columns:
        keep = keep | (F.coalesce("affected_neighbors", F.lit(0)) >= neighbors)
    return signals.join(first, SERIES).withColumn("keep", keep).drop("_first")


def affected_neighbors(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """``signals`` with the number of graph neighbours of their entity that have a signal themselves."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    hit = signals.select(F.col("entity_id").alias("dst")).distinct()
    counts = both.where("src != dst").join(hit, "dst").groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("affected_neighbors"))
    return signals.join(counts, "entity_id", "left").withColumn("affected_neighbors", F.coalesce("affected_neighbors", F.lit(0)))


def anomaly_sessions(scores: DataFrame, low: float = 0.5) -> DataFrame:
    """Sessions of a series; three low scores in a row end one. A point that ``anomalous`` (where there is such a column) calls normal scores 0."""
    if "anomalous" in scores.columns:
        scores = scores.withColumn("score", F.when(F.col("anomalous"), F.col("score")).otherwise(0.0))
    w = W.partitionBy(*SERIES).orderBy("ts", "event_id")
    last3 = w.rowsBetween(-2, 0)
    closes = (F.max("score").over(last3) < low) & (F.count("score").over(last3) == 3)
    rows = scores.withColumn("closes", closes.cast("int"))
    rows = rows.withColumn("session", F.coalesce(F.sum("closes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    found = rows.groupBy(*SERIES, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max("score").alias("peak"), F.count(F.lit(1)).alias("points"), (F.max("closes") == 1).alias("resolved"))
    return found.withColumn("duration_s", (F.unix_micros("ended") - F.unix_micros("started")) / 1e6)


def adwin_drift(metrics: DataFrame, delta: float = 0.002, least: int = 30, per_size: int = 5) -> DataFrame:
    """``event_id, window_size, drift`` of each value of a series under an adaptive window of exponential buckets.

    A cut that parts the window into two with means further apart than the Hoeffding bound
    drops the older part. Each step depends on the one before, so a task walks its series in
    order, as Spark has sorted them, and holds one window of logarithmic size.
    """
    log, sqrt = math.log, math.sqrt

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, sizes, sums = None, [], []
        for batch in batches:
            size, drift = [], []
            for key, value in zip(zip(batch["entity_id"], batch["metric_name"], strict=True), batch["value"], strict=True):
                if key != series:
                    series, sizes, sums = key, [], []
                sizes.append(1)
                sums.append(value)
                # Of more than per_size buckets of a size the two oldest are joined, and so on upwards.
                one = 1
                while sizes.count(one) > per_size:
                    at = sizes.index(one)
                    sizes[at : at + 2], sums[at : at + 2] = [2 * one], [sums[at] + sums[at + 1]]
                    one *= 2
                fired = False
                while sum(sizes) >= least and (cut := first_cut(sizes, sums)):
                    fired = True
                    del sizes[:cut], sums[:cut]
                size.append(sum(sizes))
                drift.append(fired)
            yield pd.DataFrame({"event_id": batch["event_id"], "window_size": size, "drift": drift})

    def first_cut(sizes: list[int], sums: list[float]) -> int:
        n, total, left, part = sum(sizes), sum(sums), 0, 0.0
        bound = log(4 * n / delta) / 2
        for k in range(len(sizes) - 1):
            left, part = left + sizes[k], part + sums[k]
            if abs(part / left - (total - part) / (n - left)) > sqrt(bound * n / (left * (n - left))):
                return k + 1
        return 0

    rows = metrics.where("value is not null").select(*SERIES, "ts", "event_id", "value")
    ordered = rows.repartition(*SERIES).sortWithinPartitions(*SERIES, "ts", "event_id").select(*SERIES, "event_id", "value")
    kind = rows.schema["event_id"].dataType.simpleString()
    return ordered.mapInPandas(walk, f"event_id {kind}, window_size long, drift boolean")


def retrain_on_drift(metrics: DataFrame, drift: DataFrame, baselines: DataFrame, last: int = 500) -> DataFrame:
    """``baselines`` with the metrics refitted that drifted, from the newest ``last`` values of each."""
    fired = metrics.join(drift.where("drift").select("event_id"), "event_id", "left_semi").select("metric_name").distinct()
    rank = F.row_number().over(W.partitionBy("metric_name").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = metrics.join(fired, "metric_name", "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= last)
    fresh = zscore_baselines(recent).withColumn("refitted", F.lit(True))
    kept = baselines.join(fired, "metric_name", "left_anti").withColumn("refitted", F.lit(False))
    return kept.unionByName(fresh)
