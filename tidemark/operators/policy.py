"""From root causes to decisions: incidents, actions, approvals, knowledge and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules import ACTIONS, FRAMEWORKS, SAFE_ACTIONS
from ..rules import SENSITIVE_ACTIONS as SENSITIVE
from .incidents import assign_owner, classify_severity, impact_score, sla_risk


def action_registry(spark: SparkSession) -> DataFrame:
    """The known actions: ``entity_type, action_type, safe, position``."""
    rows = [(kind, name, name in SAFE_ACTIONS, k) for kind, names in ACTIONS for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "entity_type string, action_type string, safe boolean, position int")


def build_incidents(root_causes: DataFrame) -> DataFrame:
    """Severity, impact, risk and owner of each root cause; arrays leave as JSON."""
    n, path, logs = (F.coalesce(F.size(c), F.lit(0)) for c in ("impacted_services", "fault_path", "log_snippets"))
    rows = root_causes.withColumn("severity", classify_severity(F.col("entity_type"), F.col("confidence"), F.col("anomaly_score"), n))
    rows = rows.withColumn("impact", impact_score(F.col("anomaly_score"), n, F.col("confidence"), F.col("severity"), path, logs))
    return rows.select(
        "incident_id", "severity", "impact", "root_cause_entity", "entity_type", "confidence",
        F.to_json("fault_path").alias("fault_path"), F.to_json("impacted_services").alias("impacted_services"),
        sla_risk(F.col("severity"), F.col("impact")).alias("sla_breach_risk"), assign_owner(F.col("severity"), F.col("confidence")).alias("assigned_to"), "created_at",
    )


def policy_decisions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Each incident with the actions of its entity type (``entity_type, action_type, safe, position``).

    The registry of actions is small and Spark may broadcast it; an incident without any
    action keeps no row here and is denied by ``route_actions``.
    """
    strong = F.col("severity").isin("P1", "P2") & (F.col("confidence") > 95)
    allow = strong & F.col("safe") & ~F.col("action_type").isin(*SENSITIVE)
    needs = F.col("action_type").isin(*SENSITIVE) | (F.col("safe") & ~allow)
    reason = F.when(allow, "safe action, strong incident").when(F.col("action_type").isin(*SENSITIVE), "sensitive action").when(needs, "confidence or severity too low").otherwise("action is not safe")
    return incidents.join(actions, "entity_type").withColumns({"allow": allow, "needs_approval": needs, "reason": reason})


def route_actions(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per incident: its first allowed action, else its first that needs approval, else a denial."""
    route = F.when(F.col("allow"), "auto").when(F.col("needs_approval"), "approval")
    best = decisions.withColumn("route", route).where(F.col("route").isNotNull())
    first = F.min(F.struct((F.col("route") != "auto").alias("later"), "position", "action_type", "route")).alias("first")
    best = best.groupBy("incident_id").agg(first).select("incident_id", "first.action_type", "first.route")
    return incidents.select("incident_id").join(best, "incident_id", "left").withColumn("route", F.coalesce("route", F.lit("deny")))


def pending_approvals(decided: DataFrame, proposer: str = "orchestrator") -> DataFrame:
    rows = decided.where(F.col("route") == "approval")
    name = F.concat_ws("|", "incident_id", "action_type")
    return rows.select(F.concat(F.lit("apr-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 12)).alias("approval_id"), "incident_id", "action_type", F.lit(proposer).alias("proposed_by"), F.lit("pending").alias("status"))


def list_approvals(approvals: DataFrame, n: int = 100) -> DataFrame:
    """The newest pending approvals."""
    return approvals.where("status = 'pending'").orderBy(F.desc("created_at"), "approval_id").limit(n)


def decide_approvals(approvals: DataFrame, decisions: DataFrame) -> DataFrame:
    """``approvals`` with the latest decision (``approval_id, status, decided_at``) of each that is pending."""
    rank = F.row_number().over(W.partitionBy("approval_id").orderBy(F.desc("decided_at"), "status"))
    last = decisions.withColumn("rank", rank).where("rank = 1").select("approval_id", F.col("status").alias("new_status"), F.col("decided_at").alias("new_time"))
    rows = approvals.join(last, "approval_id", "left")
    now = (F.col("status") == "pending") & F.col("new_status").isNotNull()
    old = F.col("decided_at") if "decided_at" in approvals.columns else F.lit(None).cast("timestamp")
    return rows.withColumn("decided_at", F.when(now, F.col("new_time")).otherwise(old)).withColumn("status", F.when(now, F.col("new_status")).otherwise(F.col("status"))).drop("new_status", "new_time")


def artefact_names(artefacts: DataFrame) -> DataFrame:
    """Names in the JSON text of generated artefacts (``incident_id, body``): words with a digit, ``-`` or ``_`` inside."""
    words = F.regexp_extract_all("body", F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z]+[0-9]+)"), 1)
    return artefacts.select("incident_id", F.explode(words).alias("name")).distinct()


def artefact_entities(artefacts: DataFrame, filler: DataFrame) -> DataFrame:
    """``incident_id, name``: what could be an entity among the string values of generated JSON (``incident_id, body``).

    A value counts in lower case, trimmed, if it has a letter or digit, no more than 100
    characters and no word of ``filler`` (``word``), a table of words that are never entities.
    """
    # Strings one behind the other, those before a colon with it.
    strings = F.regexp_extract_all("body", F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    raw = F.explode(F.filter(strings, lambda x: x.endswith('"')))
    text = F.from_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")), "array<string>")[0]
    names = artefacts.select("incident_id", raw.alias("raw")).select("incident_id", F.lower(F.trim(text)).alias("name")).distinct()
    names = names.where(F.col("name").rlike("[a-z0-9]") & (F.length("name") <= 100))
    words = names.select("incident_id", "name", F.explode(F.split("name", r"\s+")).alias("word"))
    plain = words.join(filler.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select("incident_id", "name").distinct()
    return names.join(plain, ["incident_id", "name"], "left_anti")


def feedback_to_knowledge(results: DataFrame) -> DataFrame:
    """Action results as knowledge rows."""
    ok = F.col("success")
    text = F.concat(F.col("action_type"), F.lit(" on "), F.col("entity_id"), F.when(ok, " succeeded").otherwise(" failed"))
    return results.select(
        F.concat(F.lit("kb-"), "action_id").alias("kb_id"), "incident_id", F.col("entity_id").alias("root_cause_entity"), text.alias("resolution_summary"),
        F.to_json(F.array("action_type")).alias("actions_taken"), F.when(ok, "success").otherwise("failure").alias("outcome"),
        "action_type", ok.cast("long").alias("success_count"),
    )


def framework(report_type: Column, frameworks: dict[str, str] = FRAMEWORKS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in frameworks.items() for x in pair])
    return F.coalesce(F.element_at(table, report_type), F.lit("General"))


def compliance_status(incidents: DataFrame, audit: DataFrame) -> DataFrame:
    """State of each incident and the number of its audit objects."""
    state = F.when(F.col("impact") > 80, "AT RISK").when(F.col("risk") == "HIGH", "BREACH IMMINENT").otherwise("COMPLIANT")
    counts = audit.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_audit"))
    return incidents.join(counts, "incident_id", "left").select("incident_id", state.alias("state"), F.coalesce("n_audit", F.lit(0)).alias("n_audit"))


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_]", "")


def grounding_check(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Names in generated artefacts (``incident_id, name``) that no entity of the incident (``incident_id, entity``) accounts for.

    A name is grounded if one of the two begins with the other, in plain form or without
    ``-`` and ``_``. The join runs inside an incident only, whose entities are few.
    """
    left, right = names.distinct(), entities.distinct()
    a, b, c, d = F.lower("name"), F.lower("entity"), _plain(F.col("name")), _plain(F.col("entity"))
    met = a.startswith(b) | b.startswith(a) | c.startswith(d) | d.startswith(c)
    known = left.join(right, "incident_id").where(met).select("incident_id", "name").distinct()
    bad = left.join(known, ["incident_id", "name"], "left_anti").groupBy("incident_id").agg(F.sort_array(F.collect_set("name")).alias("hallucinated"))
    out = left.select("incident_id").distinct().join(bad, "incident_id", "left")
    return out.select("incident_id", F.coalesce("hallucinated", F.array().cast("array<string>")).alias("hallucinated"), F.col("hallucinated").isNull().alias("valid"))
