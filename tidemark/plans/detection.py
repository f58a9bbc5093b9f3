"""From metric points to enriched anomaly signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, forest, seasonal
from ..rules import SECURITY_WORDS

WEIGHTS = {"score": 0.6, "seasonal_score": 0.4}
FOREST_WEIGHT = 0.5


def score_points(points: DataFrame, history: DataFrame, edges: DataFrame | None = None, model=None, threshold: float = 0.7, least_rows: int = 30, trees: tuple[tuple[str, ...], forest.Forest | None] | None = None, deviations: float | None = None) -> DataFrame:
    """``points`` with ``score``, ``anomalous``, ``source_type`` and, with ``edges``, ``affected_neighbors``.

    Metrics with fewer than ``least_rows`` points of history are not scored yet. Points are
    scored by z-score and seasonal distance, fused (``model`` of ``fit_fusion``, else the
    weighted mean) and compared with the threshold. ``trees``, feature columns of ``points`` and a
    forest over them, add its score. With ``deviations`` a score has besides to reach the adaptive
    threshold of its series, the mean and so many deviations of its values in ``history``; a
    series with fewer than two values has none.
    """
    warm = history.groupBy("metric_name").agg(F.count("value").alias("n")).where(F.col("n") >= least_rows).select("metric_name")
    rows = points.join(warm, "metric_name", "left_semi")
    rows = detect.zscore_score(rows, detect.zscore_baselines(history))
    rows = detect.seasonal_naive_score(rows, history)
    weights = WEIGHTS
    if trees is not None:
        rows, weights = forest.forest_score(rows, *trees), WEIGHTS | {"forest_score": FOREST_WEIGHT}
    rows = seasonal.fuse_fitted(rows, model, weights)
    scored = rows.withColumn("anomalous", F.col("fused") >= threshold).withColumn("score", F.col("fused"))
    if deviations is not None:
        own = history.groupBy(*detect.SERIES).agg(F.when(F.count("value") >= 2, F.avg("value") + deviations * F.stddev_pop("value")).alias("_limit"))
        scored = scored.join(own, detect.SERIES, "left").withColumn("anomalous", F.col("anomalous") & F.coalesce(F.col("score") >= F.col("_limit"), F.lit(True))).drop("_limit")
    security = F.lit(False)
    for word in SECURITY_WORDS:
        security = security | F.lower("metric_name").contains(word)
    scored = scored.withColumn("source_type", F.when(security, "security").otherwise("performance"))
    if edges is not None:
        around = detect.affected_neighbors(scored.where("anomalous"), edges).select("entity_id", "affected_neighbors").distinct()
        scored = scored.join(around, "entity_id", "left").withColumn("affected_neighbors", F.coalesce("affected_neighbors", F.lit(0)))
    return scored


def enriched(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """Signals with their node and confidence."""
    return seasonal.enrich_signals(kept, nodes).withColumn("confidence", F.col("fused") * 100)


def detect_pipeline(points: DataFrame, history: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, model=None, threshold: float = 0.7, least_rows: int = 30, **more) -> tuple[DataFrame, DataFrame]:
    """Signals (one row for each anomalous point that is not noise, with its node) and sessions of all scored points (``more``: see ``score_points``)."""
    scored = score_points(points, history, edges, model, threshold, least_rows, **more)
    kept = detect.suppress_noise(scored.where("anomalous")).where("keep").drop("keep")
    return enriched(kept, nodes), detect.anomaly_sessions(scored)
