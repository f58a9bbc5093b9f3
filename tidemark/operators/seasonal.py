"""Seasonal baselines, composite scores and enrichment of signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..rules import RELEVANT_REASONS, RELEVANT_WORDS, SECURITY_WORDS

SERIES = ["entity_id", "metric_name"]


def seasonal_grid(metrics: DataFrame, seconds: int = 300) -> DataFrame:
    """Mean of every grid step of a series; ``step`` counts from the epoch."""
    step = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long")
    return metrics.groupBy(*SERIES, step.alias("step")).agg(F.avg("value").alias("value"))


def seasonal_periods(grid: DataFrame, periods: tuple[int, ...] = (12, 288, 2016), least: float = 0.3) -> DataFrame:
    """The candidate period with the strongest autocorrelation, of those that the series covers twice; none below ``least``."""
    span = (F.max("step") - F.min("step") + 1).alias("span")
    lags = F.explode(F.array(*map(F.lit, periods))).alias("period")
    wanted = grid.groupBy(*SERIES).agg(span).select(*SERIES, "span", lags).where(F.col("span") >= 2 * F.col("period")).drop("span")
    now = grid.join(wanted, SERIES).select(*SERIES, "period", F.col("step").alias("at"), F.col("value").alias("x"))
    later = grid.select(*SERIES, F.col("step").alias("to"), F.col("value").alias("y"))
    pairs = now.withColumn("to", F.col("at") + F.col("period")).join(later, [*SERIES, "to"])
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    found = pairs.groupBy(*SERIES, "period").agg(r.alias("r")).where(F.col("r") >= least)
    return found.groupBy(*SERIES).agg(F.max_by("period", F.struct(F.round("r", 9), -F.col("period"))).alias("period"))


def seasonal_fit(grid: DataFrame, periods: DataFrame) -> DataFrame:
    """Median of each phase; a series without a period has one phase, the whole."""
    rows = grid.join(periods, SERIES, "left").withColumn("period", F.coalesce("period", F.lit(1)))
    return rows.groupBy(*SERIES, "period", F.pmod("step", "period").alias("phase")).agg(F.median("value").alias("expected"))


def seasonal_predict(grid: DataFrame, model: DataFrame) -> DataFrame:
    """``grid`` with the ``expected`` value of each step; null where its phase was never seen."""
    periods = model.select(*SERIES, "period").distinct()
    rows = grid.join(periods, SERIES, "left").withColumn("phase", F.pmod("step", "period"))
    return rows.join(model, [*SERIES, "period", "phase"], "left").drop("phase")


def composite_anomaly(scores: DataFrame, detectors: tuple[str, ...], least: float = 0.7) -> DataFrame:
    """Entities whose greatest score over metrics and detectors is ``least`` or more."""
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in detectors]) if len(detectors) > 1 else F.coalesce(F.col(detectors[0]), F.lit(0.0))
    rows = scores.withColumn("top", top)
    best = rows.groupBy("entity_id", "ts").agg(F.max("top").alias("anomaly_score"), F.max_by("metric_name", F.struct("top", "metric_name")).alias("metric_name"))
    security = reduce(lambda a, b: a | b, [F.lower("metric_name").contains(w) for w in SECURITY_WORDS])
    return best.where(F.col("anomaly_score") >= least).withColumn("confidence", F.col("anomaly_score") * 100).withColumn("source_type", F.when(security, "security").otherwise("performance"))


def fuse_scores(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of detector scores, missing ones as zero."""
    total = sum(weights.values())
    return scores.withColumn("fused", reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()]))


def enrich_signals(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """``signals`` with name, label and criticality of their node."""
    extra = [F.col(c).alias(f"node_{c}") for c in ("anomaly_score", "last_seen") if c in nodes.columns]
    known = nodes.select(F.col("id").alias("_id"), F.col("name").alias("node_name"), F.col("label").alias("node_label"), "criticality", *extra)
    return signals.join(known, F.col("entity_id") == F.col("_id"), "left").withColumn("enriched", F.col("_id").isNotNull()).drop("_id")


def relevant_k8s_events(events: DataFrame) -> DataFrame:
    """Events (``reason, message``) that speak of pressure, restarts or evictions."""
    said = reduce(lambda a, b: a | b, [F.lower("message").contains(w) for w in RELEVANT_WORDS])
    return events.where(F.coalesce(F.lower("reason").isin(*RELEVANT_REASONS), F.lit(False)) | F.coalesce(said, F.lit(False)))


def fit_fusion(scores: DataFrame, detectors: tuple[str, ...], label: str = "label"):
    """A logistic regression from detector scores to ``label`` (0/1); None with fewer than two rows or one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = scores.where(F.col(label).isin(0, 1)).fillna(0.0, list(detectors))
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero")).first()
    if not counts["one"] or not counts["zero"]:
        return None
    vectors = VectorAssembler(inputCols=list(detectors), outputCol="_x").transform(rows.withColumn(label, F.col(label).cast("double")))
    fit = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (counts["one"] + counts["zero"]), standardization=False)
    model = fit.fit(vectors)
    return dict(zip(detectors, map(float, model.coefficients), strict=True)), float(model.intercept), counts["one"] + counts["zero"]


def fuse_fitted(scores: DataFrame, model, weights: dict[str, float], temperature: float = 1.0) -> DataFrame:
    """``fused`` and its ``fusion_confidence``: the fitted logit over the temperature, or the weighted mean where ``model`` is None."""
    if model is None:
        return fuse_scores(scores, weights).withColumn("fusion_confidence", F.lit(0.0))
    factors, intercept, n = model
    logit = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in factors.items()]) + intercept
    return scores.withColumn("fused", 1 / (1 + F.exp(-logit / temperature))).withColumn("fusion_confidence", F.lit(min(1.0, n / 100)))


def adjusted_baselines(points: DataFrame, events: DataFrame, seconds: int = 300, factor: float = 1.5) -> DataFrame:
    """``points`` with a wider ``factor`` where an event of the entity lies at most ``seconds`` back: the latest one before decides."""
    both = points.select("entity_id", "ts", F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"))
    marks = events.select("entity_id", "ts", F.lit(0).alias("_point")).withColumn("_row", F.lit(None).cast(both.schema["_row"].dataType))
    w = W.partitionBy("entity_id").orderBy("ts", "_point").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_point") == 0, F.col("ts")), ignorenulls=True).over(w)
    near = F.unix_micros("ts") - F.unix_micros("_last") <= seconds * 1_000_000
    rows = both.unionByName(marks).withColumn("_last", last).where("_point = 1")
    return rows.select("_row.*", F.when(near, factor).otherwise(1.0).alias("factor"))
