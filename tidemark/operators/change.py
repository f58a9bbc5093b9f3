"""Configuration drift, the security classifier and workspaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import APPROVED_FIELDS, ATTACK_ROUTES, DRIFT_FIELDS, DRIFT_PATTERNS

#: The order in which detectors answer for an event.
PRIORITY = ("CONFIG_DRIFT", "BRUTE_FORCE", "PRIVILEGE_ESCALATION", "DATA_EXFILTRATION")


def detect_config_drift(events: DataFrame, approved: DataFrame, patterns: tuple[str, ...] = DRIFT_PATTERNS, fields: tuple[str, ...] = DRIFT_FIELDS) -> DataFrame:
    """Events (with ``event_id``) in which a pattern is found, in a field or an attribute, unless a field or attribute names an approved change (``change_id``)."""
    attributes = "attributes" in events.columns
    text = F.concat_ws("\n", *[c for c in fields if c in events.columns], *([F.map_values("attributes")] if attributes else []))
    hits = events.where(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)))
    named = [F.col(c).cast("string") for c in APPROVED_FIELDS if c in events.columns]
    named += [F.element_at("attributes", c) for c in APPROVED_FIELDS[:4]] if attributes else []
    ids = approved.select(F.col("change_id").alias("_approved")).distinct()
    # One row for each name of a hit, so that approvals meet it by an equality.
    names = hits.select(F.col("event_id").alias("_event"), F.explode(F.array(*named)).alias("_name")).where("_name is not null") if named else None
    rows = hits if names is None else hits.join(names.join(ids, F.col("_name") == F.col("_approved"), "left_semi"), F.col("event_id") == F.col("_event"), "left_anti")
    return rows.withColumn("severity", F.lit("CRITICAL")).withColumn("confidence", F.lit(90))


def classify_security(events: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """``events`` with the first attack type by ``PRIORITY`` among the detectors' results (each with ``event_id``); events without one go."""
    hits = None
    for k, name in enumerate(PRIORITY):
        if name in found:
            rows = found[name].select("event_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("hit"))
            hits = rows if hits is None else hits.unionByName(rows)
    if hits is None:
        raise ValueError("no detector's results")
    best = hits.groupBy("event_id").agg(F.min("hit")["name"].alias("attack_type"))
    return events.drop("attack_type").join(best, "event_id").withColumn("source_type", F.lit("security"))


def route_security(events: DataFrame, found: dict[str, DataFrame], routes: tuple[tuple[str, tuple[str, ...]], ...] = ATTACK_ROUTES) -> DataFrame:
    """``classify_security`` with events sent to one detector by what they call themselves.

    The first route of which a word is in ``attack_type`` or ``event_type`` decides, then
    outbound traffic (a value in ``outbound_bytes``); only that detector's answer counts. An event
    without a route takes the first answer in the order brute force, drift, escalation, exfiltration.
    """
    kind = F.concat_ws(" ", *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in events.columns else F.lit("") for c in ("attack_type", "event_type")])
    route = F.coalesce(*[F.when(_any(kind, words), name) for name, words in routes], F.when(F.col("outbound_bytes").isNotNull(), "DATA_EXFILTRATION") if "outbound_bytes" in events.columns else F.lit(None).cast("string"))
    rows = events.select("event_id", route.alias("route"))
    order = ("BRUTE_FORCE", "CONFIG_DRIFT", "PRIVILEGE_ESCALATION", "DATA_EXFILTRATION")
    hits = None
    for k, name in enumerate(order):
        if name in found:
            own = found[name].select("event_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("hit"))
            hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        raise ValueError("no detector's results")
    best = hits.join(rows, "event_id").where(F.coalesce(F.col("route") == F.col("hit.name"), F.lit(True))).groupBy("event_id").agg(F.min("hit")["name"].alias("attack_type"))
    return events.drop("attack_type").join(best, "event_id").withColumn("source_type", F.lit("security"))


def _any(text, words):
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def workspace_graph(nodes: DataFrame, edges: DataFrame, workspace: str, asked_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of one workspace and the edges between them."""
    own = workspace_filter(nodes, workspace, asked_by)
    ids = own.select("id").distinct()
    return own, edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def workspace_filter(df: DataFrame, workspace: str, asked_by: str | None = None) -> DataFrame:
    """Rows of one workspace; rows from before there were any belong to ``default``. Who asks from another workspace is denied."""
    if asked_by is not None and asked_by != workspace:
        raise PermissionError(f"{asked_by} may not read {workspace}")
    return df.where(F.coalesce("workspace", F.lit("default")) == workspace)
