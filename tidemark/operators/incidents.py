"""Incidents: severity, impact, risk, deduplication, policy and learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def classify_severity(entity_type: Column, confidence: Column, score: Column, impacted: Column) -> Column:
    p1 = F.upper(entity_type).contains("DATABASE") & (confidence >= 85) & (impacted >= 3)
    return F.when(p1, "P1").when((confidence >= 70) | (score >= 0.7), "P2").when((confidence >= 40) | (score >= 0.4), "P3").otherwise("P4")


def impact_score(score: Column, impacted: Column, confidence: Column, severity: Column, path_length: Column, snippets: Column) -> Column:
    level = F.when(severity == "P1", 20).when(severity == "P2", 15).when(severity == "P3", 10).otherwise(5)
    parts = F.least(F.lit(40), score * 40) + F.least(F.lit(25), 5 * impacted) + F.least(F.lit(15), confidence * 0.15) + level + F.least(F.lit(10), 2 * path_length) + F.least(F.lit(5), snippets)
    return F.least(F.greatest(parts, F.lit(0)), F.lit(100))


def sla_risk(severity: Column, impact: Column) -> Column:
    base = F.when(severity == "P1", "HIGH").when(severity == "P2", "MEDIUM").otherwise("LOW")
    return F.when(impact >= 80, "HIGH").when((impact >= 50) & (base != "HIGH"), "MEDIUM").otherwise(base)


def assign_owner(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "P1") & (confidence >= 85), "auto-remediation").otherwise("oncall-engineer")


def dedup_incidents(incidents: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Incidents of an entity at most ``ttl_seconds`` after the one before are one: the first stays."""
    w = W.partitionBy("root_cause_entity").orderBy("created_at", "incident_id")
    gap = F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(w))
    rows = incidents.withColumn("opens", F.coalesce((gap > ttl_seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("opens").over(w))
    order = F.struct("created_at", "incident_id")
    return rows.groupBy("root_cause_entity", "island").agg(F.min(order)["incident_id"].alias("incident_id"), F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("deduplicated_count"), F.max("impact").alias("impact"), F.sort_array(F.collect_list("incident_id")).alias("related_incidents"))


def mine_patterns(incidents: DataFrame, min_count: int = 2, since=None) -> DataFrame:
    """Repeated (entity, severity, hour) of the incidents at or after ``since``."""
    if since is not None:
        incidents = incidents.where(F.col("created_at") >= since)
    bucket = F.date_trunc("hour", "created_at")
    out = incidents.groupBy("root_cause_entity", "severity", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pattern_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")).where(F.col("pattern_count") >= min_count)
    name = F.concat_ws("|", "root_cause_entity", "severity", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))
    return out.withColumn("pattern_id", F.concat(F.lit("pat-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 12)))


def recommend_actions(knowledge: DataFrame, success: str, k: int = 3) -> DataFrame:
    """The ``k`` most successful actions of every entity with their share of the kept total."""
    total = knowledge.where(F.col("outcome") == success).groupBy("root_cause_entity", "action_type").agg(F.sum("success_count").alias("total"))
    rank = F.row_number().over(W.partitionBy("root_cause_entity").orderBy(F.desc("total"), "action_type"))
    kept = total.withColumn("rank", rank).where((F.col("rank") <= k) & (F.trim("action_type") != ""))
    share = F.sum("total").over(W.partitionBy("root_cause_entity"))
    return kept.withColumn("all", share).where("all > 0").withColumn("confidence", F.round(F.col("total") / F.col("all") * 100, 1)).drop("all")
