"""The entity graph: nodes, edges, symptoms, root causes and aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import EDGE_PROPERTIES
from .entities import cross_cloud_canonical_id

#: Labels of the entity types that the graph holds.
LABELS = {"API_NODE": "Service", "SERVICE": "Service", "DATABASE": "Database", "WORKER_NODE": "Infrastructure", "INFRASTRUCTURE": "Infrastructure"}


def upsert_nodes(records: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """One row per id of ``records`` (``id, entity_type, ts, *properties``): of every property the last value that is not null."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.upper("entity_type"))
    known = records.withColumn("label", label).where(F.col("label").isNotNull())
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c)))
    return known.groupBy("id").agg(*[F.max_by(c, order(c)).alias(c) for c in ("label", *properties)])


def build_edges(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, type`` from the list columns ``depends_on``, ``calls`` and ``reads_from``; both ends are nodes."""
    kinds = {"depends_on": "DEPENDS_ON", "calls": "CALLS", "reads_from": "READS_FROM"}
    named = F.array(*[F.struct(F.lit(kind).alias("type"), F.coalesce(c, F.array().cast("array<string>")).alias("to")) for c, kind in kinds.items()])
    rows = records.select(F.col("id").alias("src"), F.explode(named).alias("e")).select("src", F.explode("e.to").alias("dst"), "e.type").distinct()
    ids = nodes.select("id").distinct()
    return rows.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def edge_properties(records: DataFrame, edges: DataFrame, names: dict[str, tuple[str, ...]] = EDGE_PROPERTIES) -> DataFrame:
    """``edges`` (``src, dst, type``) with ``properties``: what the records of ``src`` (``id, ts`` and columns) say about edges of that type, of each name the last value that is not null."""
    own = sorted({c for group in names.values() for c in group if c in records.columns})
    last = records.groupBy(F.col("id").alias("src")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c)))).cast("string").alias(f"_{c}") for c in own])
    none = F.create_map().cast("map<string,string>")

    def of(group: tuple[str, ...]):
        pairs = [F.struct(F.lit(c).alias("key"), F.col(f"_{c}").alias("value")) for c in group if c in own]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else none

    kinds = F.coalesce(*[F.when(F.col("type") == kind, of(group)) for kind, group in names.items()], none)
    return edges.join(last, "src", "left").select("src", "dst", "type", kinds.alias("properties"))


def topology_export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges with latency and error rate where they are known."""
    extra = [F.col(c) if c in edges.columns else F.lit(None).cast("double").alias(c) for c in ("latency_p50", "error_rate")]
    return nodes.select("id", "label"), edges.select("src", "dst", "type", *extra)


def resolve_symptoms(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """``signals`` with ``symptom``: the entity if it is a node, else its canonical id if that is one, else the entity."""
    ids = nodes.select("id").distinct()
    name = cross_cloud_canonical_id(F.col("provider"), F.col("region"), F.col("entity_type"), F.col("entity_id"))
    rows = signals.withColumn("_name", name)
    rows = rows.join(ids.select(F.col("id").alias("_plain")), F.col("entity_id") == F.col("_plain"), "left")
    rows = rows.join(ids.select(F.col("id").alias("_canonical")), F.col("_name") == F.col("_canonical"), "left")
    return rows.withColumn("symptom", F.coalesce("_plain", "_canonical", "entity_id")).drop("_plain", "_canonical", "_name")


def build_root_causes(signals: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per symptom its best root, or the symptom itself with confidence 0, and its signals in time order as evidence."""
    evidence = F.sort_array(F.collect_list(F.struct("ts", "metric_name", "score"))).alias("evidence")
    logs = [F.array_compact(F.sort_array(F.collect_list(F.struct("ts", "message")))["message"]).alias("log_snippets")] if "message" in signals.columns else []
    found = signals.groupBy("symptom").agg(evidence, *logs, F.max("score").alias("anomaly_score"))
    best = ranked.where("rank = 1").select("symptom", "root", "confidence")
    extra = ["log_snippets"] if logs else []
    return found.join(best, "symptom", "left").select("symptom", F.coalesce("root", "symptom").alias("root_cause_entity"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "anomaly_score", "evidence", *extra)


def align_by_lag(series: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Each cause moved onto its effect's index (``entity_id, metric_name, idx, value`` with ``cause, effect, lag``)."""
    cause = series.select("entity_id", F.col("metric_name").alias("cause"), F.col("idx").alias("_at"), F.col("value").alias("x"))
    effect = series.select("entity_id", F.col("metric_name").alias("effect"), "idx", F.col("value").alias("y"))
    moved = cause.join(edges.select("entity_id", "cause", "effect", "lag"), ["entity_id", "cause"]).withColumn("idx", F.col("_at") + F.col("lag")).drop("_at")
    found = moved.join(effect, ["entity_id", "effect", "idx"]).select("entity_id", "cause", "effect", "lag", "idx", "x", "y")
    # Pairs that fewer than least rows align stay on their own index, with lag 0.
    few = found.groupBy("entity_id", "cause", "effect").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("entity_id", "cause", "effect")
    raw = edges.select("entity_id", "cause", "effect").distinct().join(few, ["entity_id", "cause", "effect"], "left_anti")
    raw = cause.withColumnRenamed("_at", "idx").join(raw, ["entity_id", "cause"]).join(effect, ["entity_id", "effect", "idx"])
    return found.join(few, ["entity_id", "cause", "effect"], "left_semi").unionByName(raw.select("entity_id", "cause", "effect", F.lit(0).cast(edges.schema["lag"].dataType).alias("lag"), "idx", "x", "y"))


def correlation_ranking(series: DataFrame, anomalous: DataFrame, k: int = 5) -> DataFrame:
    """Per entity the ``k`` metrics with the greatest correlation with any of its anomalous metrics."""
    from pyspark.sql import Window as W

    marked = series.join(anomalous.select("entity_id", "metric_name").distinct(), ["entity_id", "metric_name"], "left_semi")
    other = marked.select("entity_id", F.col("metric_name").alias("other"), "idx", F.col("value").alias("y"))
    pairs = series.join(other, ["entity_id", "idx"]).where("metric_name != other")
    r = F.abs(F.try_divide(F.covar_pop("value", "y"), F.stddev_pop("value") * F.stddev_pop("y")))
    best = pairs.groupBy("entity_id", "metric_name", "other").agg(r.alias("r")).groupBy("entity_id", "metric_name").agg(F.max("r").alias("r")).where(F.col("r").isNotNull())
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc(F.round("r", 9)), "metric_name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
