"""From signals over root causes and incidents to actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import confidence
from ..operators import graph, incidents, policy, topology


def built_incidents(signals: DataFrame, nodes: DataFrame, edges: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """An incident for each symptom, with its root cause, path, evidence and scores.

    ``signals``: ``entity_id, provider, region, entity_type, metric_name, score, ts``; ``nodes``:
    ``id, entity_type``; ``edges``: ``src, dst, layer``; ``logs``: ``entity_id, ts, message``, of which
    the newest of the root cause are evidence.
    """
    marked = topology.resolve_symptoms(signals, nodes)
    paths = graph.best_paths(graph.merge_layers(edges), marked.select("symptom").distinct())
    ranked = graph.score_root_causes(paths)
    causes = topology.build_root_causes(marked, ranked)
    best = paths.groupBy("symptom", "root").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("fault_path"))
    rows = causes.join(best.withColumnRenamed("root", "root_cause_entity"), ["symptom", "root_cause_entity"], "left")
    kinds = nodes.select(F.col("id").alias("root_cause_entity"), "entity_type").dropDuplicates(["root_cause_entity"])
    rows = rows.join(kinds, "root_cause_entity", "left").withColumn("confidence", confidence(F.col("confidence")))
    none = F.array().cast("array<string>")
    rows = rows.select(
        F.sha2(F.concat_ws("|", "symptom", "root_cause_entity"), 256).alias("incident_id"), "root_cause_entity", F.coalesce("entity_type", F.lit("SERVICE")).alias("entity_type"), "confidence", "anomaly_score",
        F.coalesce("fault_path", none).alias("fault_path"), F.coalesce(F.slice("fault_path", 2, 10), none).alias("impacted_services"), F.element_at("evidence", 1)["ts"].alias("created_at"),
    )
    if logs is None:
        return policy.build_incidents(rows.withColumn("log_snippets", none))
    found = log_evidence(rows.select("incident_id", "root_cause_entity", "created_at"), logs)
    rows = rows.join(found, "incident_id", "left").withColumn("log_snippets", F.coalesce("log_snippets", none))
    return policy.build_incidents(rows)


def log_evidence(incidents: DataFrame, logs: DataFrame, seconds: int = 300, most: int = 5) -> DataFrame:
    """``incident_id, log_snippets``: the newest ``most`` messages of the root cause in the ``seconds`` before an incident (``logs``: ``entity_id, ts, message``).

    The score counts no more than five. Both sides meet on entity and interval, so a busy entity is many keys.
    """
    span = lambda c: F.floor(F.unix_seconds(c) / seconds)
    wanted = incidents.withColumn("span", F.explode(F.array(span("created_at"), span("created_at") - 1)))
    lines = logs.where("message IS NOT NULL").select(F.col("entity_id").alias("root_cause_entity"), "ts", "message", span("ts").alias("span"))
    near = lines.join(wanted, ["root_cause_entity", "span"]).where((F.col("ts") <= F.col("created_at")) & (F.col("ts") > F.col("created_at") - F.make_dt_interval(secs=F.lit(seconds))))
    rank = F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("ts"), "message"))
    newest = near.withColumn("rank", rank).where(F.col("rank") <= most)
    return newest.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("ts", "message")))["message"].alias("log_snippets"))


def incident_pipeline(signals: DataFrame, nodes: DataFrame, edges: DataFrame, actions: DataFrame, ttl_seconds: int = 300, logs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Incidents (see ``built_incidents``) with their duplicates counted, and one routed action for each."""
    built = built_incidents(signals, nodes, edges, logs)
    merged = incidents.dedup_incidents(built, ttl_seconds).select("incident_id", "deduplicated_count", F.col("impact").alias("impact_max"), "related_incidents")
    kept = built.join(merged, "incident_id").withColumn("impact", F.col("impact_max")).drop("impact_max")
    return kept, policy.route_actions(kept, policy.policy_decisions(kept, actions))
