"""Entity names and the relationships between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_entity_id(provider: Column, entity_type: Column, name: Column, raw: Column) -> Column:
    return F.concat(F.coalesce(provider, F.lit("unknown")), F.lit(":"), F.coalesce(entity_type, F.lit("UNKNOWN_NODE")), F.lit("/"), F.coalesce(name, raw))


def cross_cloud_canonical_id(provider: Column, region: Column, entity_type: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(provider)), F.lower(F.trim(region)), F.upper(F.trim(entity_type)), F.trim(name))


def build_relationships(spans: DataFrame, within_seconds: int = 600) -> DataFrame:
    """A call for each span whose parent in the same trace belongs to another service, at most ``within_seconds`` apart."""
    status = ["status"] if "status" in spans.columns else []
    child = spans.where("parent_span_id != ''").select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("span_id").alias("child_span"), F.col("service_name").alias("dst"), "duration_ms", *status, F.col("ts").alias("child_ts"))
    parent = spans.select("trace_id", "span_id", F.col("service_name").alias("src"), F.col("ts").alias("parent_ts"))
    near = F.abs(F.unix_micros("child_ts") - F.unix_micros("parent_ts")) <= within_seconds * 1_000_000
    joined = child.join(parent, ["trace_id", "span_id"]).where((F.col("src") != F.col("dst")) & near)
    return joined.select("trace_id", "child_span", "src", "dst", F.lit("CALLS").alias("type"), F.col("duration_ms").alias("latency_ms"), *status)


def registered_entities(records: DataFrame) -> DataFrame:
    """``raw_id, canonical_id``: of several names for a raw id, the first by time stays (``raw_id, provider, region, entity_type, name, ts``)."""
    name = cross_cloud_canonical_id(*map(F.col, ("provider", "region", "entity_type", "name")))
    return records.withColumn("canonical_id", name).groupBy("raw_id").agg(F.min_by("canonical_id", F.struct("ts", "canonical_id")).alias("canonical_id"))
