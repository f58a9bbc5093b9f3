"""Registered queries of sources, sinks, entities, security, graph, incidents, health and serving, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import change, detect, entities, features, forest, graph, health, incidents, policy, resources, seasonal, security, serving, topology
from .plans.detection import detect_pipeline
from .queries import VIEWS, _micros, query
from .sources import ingest, otlp, sinks, tables


def _pick(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_NAMES = "['svc-' || k FOR k IN range(0, o_orderkey % {by})]"
VIEWS |= {
    "resource_ids": "SELECT c_custkey, " + _pick("c_custkey", "projects/p1/zones/us-central1-a/instances/vm-", "arn:aws:ec2:eu-west-1:123:instance/payment-", "i-0000abcd", "arn:aws:rds:us-east-1:12:db:postgres-", "k8s:pod:shop/frontend-", "azure:vm:checkout-", "projects/p/instances/mysql-", "k8s:service:shop/catalog-", "odd id ") + " || c_custkey AS raw_id, 1700000000 + c_custkey * 7 AS seen FROM customer",
    "security_events": "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user-' || user_id END AS entity_id, CASE WHEN user_id % 7 = 0 THEN 'ADMIN_NODE' ELSE 'API_NODE' END AS entity_type, " + _pick("event_id", "sudo bash", "config_file_changed", "login failed", "Unauthorized config of host change", "all well", "role_change asked", "resume", "") + " AS message, CASE WHEN event_type = 'error' THEN 'AUTH_FAILURE' ELSE 'NONE' END AS event_type, 'chg-' || (event_id % 50) AS change_id, '10.0.0.' || (user_id % 20) AS source_ip, value AS outbound_bytes, ts FROM events",
    "anomalies": "SELECT event_id AS anomaly_id, CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN event_type = 'error' THEN 'security' ELSE 'performance' END AS source_type, " + _pick("event_id", "BRUTE_FORCE", "CONFIG_DRIFT", "DATA_EXFILTRATION") + " AS attack_type, " + _pick("event_id", "HIGH", "LOW", "CRITICAL", "MEDIUM") + " AS severity, CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'resolved' END AS status, CASE user_id % 20 WHEN 3 THEN 'unknown' WHEN 4 THEN '' ELSE '10.0.0.' || (user_id % 20) END AS source_ip, value, ts FROM events",
    "root_causes": "SELECT o_orderkey AS incident_id, 'svc-' || (o_custkey % 50) AS root_cause_entity, " + _pick("o_custkey", "API_NODE", "DATABASE_NODE", "SERVICE", "K8S_RESOURCE", "INFRASTRUCTURE") + " AS entity_type, CAST(o_orderkey * 37 % 101 AS DOUBLE) AS confidence, (o_orderkey * 13 % 100) / 100.0 AS anomaly_score, " + ", ".join(_NAMES.format(by=n) + f" AS {c}" for n, c in ((6, "impacted_services"), (5, "fault_path"), (7, "log_snippets"))) + ", o_orderdate AS created_at FROM orders",
    "approvals": "SELECT 'apr-' || o_orderkey AS approval_id, o_orderkey AS incident_id, " + _pick("o_custkey", "block_ip", "rollback") + " AS action_type, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS decided_at FROM orders",
    "kb_rows": "SELECT 'kb-' || o_orderkey AS kb_id, 'svc-' || (o_custkey % 50) AS root_cause_entity, o_orderpriority AS resolution_summary, o_orderdate AS created_at FROM orders",
    "nodes": "SELECT 'n' || s_suppkey AS id, s_name AS name, " + _pick("s_nationkey", "SERVICE", "DATABASE", "INFRASTRUCTURE", "ODD") + " AS entity_type, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS anomaly_score, CASE s_suppkey % 3 WHEN 0 THEN 'team-a' WHEN 1 THEN 'team-b' END AS workspace FROM supplier",
    "edges": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'n' || (s_suppkey // 3) ELSE 'n' || s_suppkey END AS src, CASE WHEN s_suppkey % 4 = 0 THEN 'n' || s_suppkey ELSE 'n' || (s_suppkey // 3) END AS dst, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 1 END AS layer FROM supplier WHERE s_suppkey > 0",
}


# Sources and sinks


def _otlp_metrics(spark, d):
    e = tables.table(spark, d, "events").where("event_type is not null and value is not null")
    nanos = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    return e.select(F.format_string('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"u%s"}}]},"scopeMetrics":[{"metrics":[{"name":"%s","unit":"ms","gauge":{"dataPoints":[{"timeUnixNano":"%s","asDouble":%s},{"timeUnixNano":"%s","asInt":"%s"}]}}]}]}]}', F.col("user_id").cast("string"), "event_type", nanos, F.col("value").cast("string"), nanos, F.col("event_id").cast("string")).alias("value"))


@query("SELECT 'u' || user_id AS entity_id, event_type AS metric_name, v AS value, epoch_us(ts) AS ts FROM (SELECT user_id, event_type, ts, unnest([value, CAST(event_id AS DOUBLE)]) AS v FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)")
def parse_otlp_metrics(spark, d):
    return _micros(otlp.parse_otlp_metrics(_otlp_metrics(spark, d)).select("entity_id", "metric_name", "value", "ts"))


@query("WITH h AS (SELECT entity_id, metric_name, CAST(sum(value) AS DOUBLE) AS s, count(value) AS n, count(*) FILTER (value <= 5) AS a, count(*) FILTER (value <= 20) AS b FROM metrics WHERE entity_id IS NOT NULL AND metric_name IS NOT NULL GROUP BY 1, 2) SELECT entity_id, metric_name || '_sum' AS metric_name, round(coalesce(s, 0), 6) AS value, CAST(NULL AS VARCHAR) AS bound, CAST(n AS VARCHAR) AS count FROM h UNION ALL SELECT entity_id, metric_name || '_bucket', a, '5.0', CAST(a AS VARCHAR) FROM h UNION ALL SELECT entity_id, metric_name || '_bucket', b, '20.0', CAST(b AS VARCHAR) FROM h UNION ALL SELECT entity_id, metric_name || '_bucket', 0, '50.0', '0' FROM h")
def parse_otlp_histograms(spark, d):
    """Histogram points of each series; the last bound has no count."""
    point = F.struct(F.lit("1700000000000000000").alias("timeUnixNano"), F.count("value").alias("count"), F.sum("value").alias("sum"), F.array(F.lit(5.0), F.lit(20.0), F.lit(50.0)).alias("explicitBounds"), F.array(F.count_if(F.col("value") <= 5), F.count_if(F.col("value") <= 20)).cast("array<string>").alias("bucketCounts"))
    rows = tables.metrics(spark, d).where("entity_id is not null and metric_name is not null").groupBy("entity_id", "metric_name").agg(point.alias("p"))
    metric = F.struct(F.col("metric_name").alias("name"), F.struct(F.array("p").alias("dataPoints")).alias("histogram"))
    name = F.struct(F.lit("service.name").alias("key"), F.struct(F.col("entity_id").alias("stringValue")).alias("value"))
    whole = F.struct(F.struct(F.array(name).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
    raw = rows.select(F.to_json(F.struct(F.array(whole).alias("resourceMetrics"))).alias("value"))
    return _micros(otlp.parse_otlp_metrics(raw).select("entity_id", "metric_name", "value", F.col("attributes")["bound"].alias("bound"), F.col("attributes")["count"].alias("count")))


@query("SELECT 'u' || user_id AS entity_id, CASE WHEN event_id % 25 BETWEEN 1 AND 4 THEN 'TRACE' WHEN event_id % 25 BETWEEN 5 AND 8 THEN 'DEBUG' WHEN event_id % 25 BETWEEN 9 AND 12 THEN 'INFO' WHEN event_id % 25 BETWEEN 13 AND 16 THEN 'WARN' WHEN event_id % 25 >= 17 THEN 'ERROR' ELSE 'odd' END AS log_level, event_type AS message, epoch_us(ts) AS ts FROM events WHERE event_type IS NOT NULL")
def parse_otlp_logs(spark, d):
    e = tables.table(spark, d, "events").where("event_type is not null")
    nanos = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    raw = e.select(F.format_string('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.instance.id","value":{"stringValue":"u%s"}}]},"scopeLogs":[{"logRecords":[{"observedTimeUnixNano":"%s","severityNumber":%s,"severityText":"odd","body":{"stringValue":"%s"}}]}]}]}', F.col("user_id").cast("string"), nanos, (F.col("event_id") % 25).cast("string"), "event_type").alias("value"))
    return _micros(otlp.parse_otlp_logs(raw).select("entity_id", "log_level", "message", "ts"))


@query("SELECT trace_id, CAST(span_id AS VARCHAR) AS span_id, CAST(floor(duration_ms) AS BIGINT) AS duration_ms, CASE span_id % 3 WHEN 1 THEN 'OK' WHEN 2 THEN 'ERROR' ELSE 'UNSET' END AS status, epoch_us(ts) AS ts FROM traces")
def parse_otlp_traces(spark, d):
    t = tables.traces(spark, d)
    start = F.unix_micros("ts")
    end = start * 1000 + (F.col("duration_ms") * 1_000_000).cast("long")
    raw = t.select(F.format_string('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"%s"}}]},"scopeSpans":[{"spans":[{"traceId":"%s","spanId":"%s","name":"op","startTimeUnixNano":"%s000","endTimeUnixNano":"%s","status":{"code":%s},"attributes":[]}]}]}]}', "service_name", F.col("trace_id").cast("string"), "span_id", start.cast("string"), end.cast("string"), (F.col("span_id").cast("int") % 3).cast("string")).alias("value"))
    return _micros(otlp.parse_otlp_traces(raw).select(F.col("trace_id").cast("long").alias("trace_id"), "span_id", "duration_ms", "status", "ts"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'metrics' WHEN 1 THEN 'logs' WHEN 2 THEN 'traces' ELSE 'events' END AS signal FROM events")
def route_signal_type(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("resourceMetrics", "resourceLogs", "resourceSpans", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    raw = tables.table(spark, d, "events").select("event_id", F.concat(F.lit('{"'), key, F.lit('":[]}')).alias("value"))
    return otlp.route_signal_type(raw).select("event_id", "signal")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS entity_id, CASE event_id % 6 WHEN 0 THEN 'BRUTE_FORCE' WHEN 1 THEN 'DATA_EXFILTRATION' WHEN 2 THEN 'UNKNOWN_ATTACK' WHEN 3 THEN 'BRUTE_FORCE' WHEN 4 THEN 'PRIVILEGE_ESCALATION' ELSE 'PORT_SCAN' END AS attack_type, least(greatest(round(value, 2) / 10, 0), 1) AS confidence, epoch_us(ts) // 1000 AS at FROM events WHERE value IS NOT NULL")
def parse_security_events(spark, d):
    e = tables.table(spark, d, "events").where("value is not null")
    attack = F.element_at(F.array(F.lit('"attackType":"brute_force_attempt",'), F.lit('"attack_type":" Potential_Data_Exfiltration",'), F.lit(""), F.lit('"attackType":"Brute_Force_Attack",'), F.lit('"attackType":"privilege_escalation_attempt",'), F.lit('"attackType":"port_scan",')), (F.col("event_id") % 6 + 1).cast("int"))
    share = (F.round("value", 2) / 10).cast("string")
    raw = e.select(F.concat(F.lit('{"eventId":"'), "event_id", F.lit('","entity_id":"'), "user_id", F.lit('",'), attack, F.lit('"confidence":"'), share, F.lit('","timestamp":"'), F.unix_millis(F.col("ts").cast("timestamp")), F.lit('","x":"y"}')).alias("value"))
    return ingest.parse_security_events(raw).select("event_id", "entity_id", "attack_type", "confidence", F.unix_millis("ts").alias("at"))


@query("SELECT entity_id, metric_name || '_sum' AS metric_name, round(sum(value), 6) AS value, CAST(NULL AS DOUBLE) AS le FROM metrics GROUP BY entity_id, metric_name UNION ALL SELECT entity_id, metric_name || '_bucket', CAST(count(*) FILTER (value <= b) AS DOUBLE), b FROM metrics, (SELECT unnest([5.0, 20.0]) AS b) GROUP BY entity_id, metric_name, b")
def explode_histograms(spark, d):
    points = tables.metrics(spark, d).groupBy("entity_id", "metric_name").agg(F.max("ts").alias("ts"), F.sum("value").alias("sum"), F.array(F.count_if(F.col("value") <= 5), F.count_if(F.col("value") <= 20), F.count("value")).alias("counts")).withColumn("bounds", F.array(F.lit(5.0), F.lit(20.0)))
    return _micros(ingest.explode_histograms(points).select("entity_id", "metric_name", "value", "le"))


@query("SELECT CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS log_level, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 2 = 1 THEN 'state batch' END AS message, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000000 ELSE 1700000000 END AS at FROM events WHERE event_type = 'error' OR event_id % 2 = 1")
def split_ingest_batches(spark, d):
    e = tables.table(spark, d, "events")
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    log = F.when(F.col("event_type") == "error", F.array(F.struct(F.lit(None).cast("string").alias("level"), F.lit("failed").alias("message"), when.alias("timestamp"))))
    none = F.lit(None).cast("array<struct<name:string,value:double,timestamp:string>>")
    spans = F.lit(None).cast("array<struct<trace_id:string,span_id:string,parent_span_id:string,duration_ms:double,timestamp:string>>")
    rows = e.select(F.when(F.col("event_id") % 2 == 0, "siem").otherwise("state").alias("type"), F.col("user_id").cast("string").alias("entity_id"), none.alias("metrics"), log.alias("logs"), spans.alias("traces"))
    logs = ingest.split_batches(rows, F.timestamp_seconds(F.lit(1_700_000_000)))["logs"]
    return logs.select("entity_id", "log_level", "message", F.unix_seconds("ts").alias("at"))


@query("WITH t AS (SELECT entity_id, metric_name, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS s, count(value) AS c FROM metrics GROUP BY 1, 2, 3) SELECT metric_name, s AS window_start, c AS count FROM t WHERE entity_id = '7' AND s >= 1704067200000000 AND s + 300000000 <= 1706745600000000")
def read_features(spark, d):
    windows = features.tumbling_features(tables.metrics(spark, d))
    return _micros(ingest.read_features(windows, "7", "5 minutes", "2024-01-01", "2024-02-01").select("metric_name", "window_start", "count"))


@query("SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderstatus END AS status FROM orders")
def upsert_latest(spark, d):
    base = tables.incidents(spark, d).select("incident_id", "status", F.lit(1).alias("version"))
    changes = base.where("incident_id % 3 = 0").select("incident_id", F.lit("closed").alias("status"), F.lit(2).alias("version"))
    return sinks.upsert_latest(base, changes, "incident_id", "version").select("incident_id", "status")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def apply_retention(spark, d):
    return sinks.apply_retention(tables.metrics(spark, d), "ts", 10, "2024-01-20 00:00:00").select("event_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'team-a' WHEN 1 THEN 'b2_x' END AS workspace, event_id % 4 < 2 AS routed FROM events")
def route_by_workspace(spark, d):
    slug = F.element_at(F.array(F.lit("team-a"), F.lit("b2_x"), F.lit("Bad Slug"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    routed, skipped = sinks.route_by_workspace(tables.metrics(spark, d).withColumn("attributes", F.create_map(F.lit("workspace.name"), slug)), "workspace.name")
    return routed.select("event_id", "workspace", F.lit(True).alias("routed")).unionByName(skipped.select("event_id", F.lit(None).cast("string").alias("workspace"), F.lit(False).alias("routed")))


@query("SELECT CAST(incident_id AS VARCHAR) AS key, incident_id, severity FROM incidents")
def topic_rows(spark, d):
    rows = sinks.topic_rows(tables.incidents(spark, d).select("incident_id", "severity"), "incident_id")
    return rows.select("key", F.from_json("value", "incident_id long, severity string").alias("x")).select("key", "x.*")


# Normalisation and entities


@query("SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'TRACE' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'INFO' WHEN 5 THEN 'INFO' WHEN 6 THEN 'DEBUG' ELSE 'FATAL' END AS level FROM events")
def normalize_log_severity(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("trace2", "Critical", "NOTICE", " warning ", "odd", None, "DEBUG4", "EMERGENCY", "FATAL2", "fatal3", "Fatal4")]), (F.col("event_id") % 11 + 1).cast("int"))
    return tables.table(spark, d, "events").select("event_id", N.log_severity(raw).alias("level"))


@query("SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'API_NODE' WHEN 1 THEN 'DATABASE_NODE' WHEN 2 THEN 'DATABASE_NODE' WHEN 3 THEN 'WORKER_NODE' WHEN 4 THEN 'INFRASTRUCTURE' WHEN 5 THEN 'WORKER_NODE' WHEN 6 THEN 'API_NODE' WHEN 7 THEN 'DATABASE_NODE' WHEN 8 THEN 'API_NODE' ELSE 'HOST' END AS entity_type FROM customer")
def infer_entity_type(spark, d):
    service = F.element_at(F.array(*map(F.lit, ("Payments-API", "orders-db", "redis-cache", "worker-1", "dns", "queue", "frontend", "LoadBalancer", "x", "mysql"))), (F.col("c_custkey") % 10 + 1).cast("int"))
    given = F.when(F.col("c_custkey") % 10 == 9, "HOST").when(F.col("c_custkey") % 2 == 0, "API_NODE")
    return tables.table(spark, d, "customer").select("c_custkey", N.entity_type(given, service).alias("entity_type"))


@query("SELECT o_orderkey, right('0000000000000000' || lower(regexp_replace('x-' || o_orderkey || 'Ffg', '[^0-9a-fA-F]', '', 'g')), 16) AS span_id, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'ERROR' ELSE 'UNSET' END AS status FROM orders")
def normalize_spans(spark, d):
    o = tables.table(spark, d, "orders")
    code = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "P", "2").otherwise("")
    return o.select("o_orderkey", N.hex_id(F.concat(F.lit("x-"), "o_orderkey", F.lit("Ffg")), 16).alias("span_id"), N.span_status(code).alias("status"))


@query("SELECT event_id, 'API_NODE' AS entity_type, 'performance' AS source_type, CASE WHEN event_id % 5 = 0 THEN 1700000000 ELSE epoch_us(ts) // 1000000 END AS at FROM events WHERE event_id % 3 <> 0")
def validate_required(spark, d):
    rows = tables.metrics(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise("e").alias("entity_id"), F.when(F.col("event_id") % 5 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts")).alias("ts"))
    return N.validated(rows, F.timestamp_seconds(F.lit(1_700_000_000))).select("event_id", "entity_type", "source_type", F.unix_seconds("ts").alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'given' ELSE 'ns-' || user_id END AS namespace, CAST(NULL AS VARCHAR) AS pod FROM events")
def enrich_k8s_context(spark, d):
    name = F.create_map(F.lit("k8s.namespace.name"), F.concat(F.lit("ns-"), "entity_id"))
    attrs = F.when(F.col("event_id") % 2 == 0, F.map_concat(name, F.create_map(F.lit("k8s.namespace"), F.lit("given")))).otherwise(name)
    found = tables.metrics(spark, d).select("event_id", N.k8s_context(attrs).alias("a"))
    return found.select("event_id", F.element_at("a", "k8s.namespace").alias("namespace"), F.element_at("a", "k8s.pod").alias("pod"))


@query("SELECT event_id, round(CASE WHEN value IS NULL THEN NULL WHEN value <= 1 THEN greatest(value * 100, 0) WHEN value < 2 THEN 100 ELSE least(value, 100) END, 6) AS confidence FROM events")
def normalize_confidence(spark, d):
    return _micros(tables.metrics(spark, d).select("event_id", N.confidence(F.col("value")).alias("confidence")))


_PARSED = "p AS (SELECT raw_id, " + ", ".join(
    f"CASE c_custkey % 9 {' '.join(f'WHEN {n} THEN {v}' for n, v in enumerate(values))} END AS {name}"
    for name, values in {
        "provider": ("'gcp'", "'aws'", "CASE WHEN regexp_full_match(raw_id, 'i-[0-9a-f]{8,17}') THEN 'aws' ELSE 'unknown' END", "'aws'", "'k8s'", "'azure'", "'gcp'", "'k8s'", "'unknown'"),
        "region": ("'us-central1'", "'eu-west-1'", "''", "'us-east-1'", "''", "''", "''", "''", "''"),
        "entity_type": ("'API_NODE'", "'API_NODE'", "CASE WHEN regexp_full_match(raw_id, 'i-[0-9a-f]{8,17}') THEN 'API_NODE' END", "'DATABASE_NODE'", "'API_NODE'", "'API_NODE'", "'DATABASE_NODE'", "'API_NODE'", "NULL"),
        "name": ("'vm-' || c_custkey", "'payment-' || c_custkey", "raw_id", "'postgres-' || c_custkey", "'frontend-' || c_custkey", "'checkout-' || c_custkey", "'mysql-' || c_custkey", "'catalog-' || c_custkey", "raw_id"),
    }.items()
) + " FROM resource_ids)"


def _parsed(spark, d):
    return tables.resources(spark, d).withColumn("id", resources.parse_resource_id(F.col("raw_id"))).select("raw_id", "ts", "id.*")


@query(f"WITH {_PARSED} SELECT raw_id, provider, region, entity_type, name, provider <> 'unknown' AS matched, provider || ':' || coalesce(entity_type, 'UNKNOWN_NODE') || '/' || name AS entity_id FROM p")
def parse_resource_id(spark, d):
    name = entities.canonical_entity_id(*map(F.col, ("provider", "entity_type", "name", "raw_id")))
    return _parsed(spark, d).select("raw_id", "provider", "region", "entity_type", "name", "matched", name.alias("entity_id"))


@query(f"WITH {_PARSED} SELECT raw_id, CASE WHEN entity_type = 'DATABASE_NODE' THEN 'HIGH' WHEN name LIKE 'payment%' OR name LIKE 'checkout%' THEN 'CRITICAL' WHEN entity_type = 'API_NODE' THEN 'MEDIUM' ELSE 'LOW' END AS criticality, CASE WHEN entity_type = 'DATABASE_NODE' THEN '24x7' WHEN name LIKE 'payment%' OR name LIKE 'checkout%' THEN '24x7' WHEN entity_type = 'API_NODE' THEN 'Business Hours' ELSE 'Best Effort' END AS sla_tier, CASE WHEN entity_type = 'DATABASE_NODE' THEN 'platform-db' WHEN entity_type IS NULL THEN NULL WHEN name LIKE 'payment%' OR name LIKE 'checkout%' THEN 'payments-team' WHEN name LIKE 'catalog%' THEN 'catalog-team' WHEN name LIKE 'frontend%' THEN 'web-team' ELSE 'platform-team' END AS owner_team FROM p")
def enrich_business_tags(spark, d):
    tags = _parsed(spark, d).select("raw_id", resources.business_tags(F.col("entity_type"), F.col("name")).alias("t"))
    return tags.select("raw_id", *[F.element_at("t", c).alias(c) for c in ("criticality", "sla_tier", "owner_team")])


@query(f"WITH {_PARSED} SELECT raw_id, lower(provider) || ':' || lower(region) || ':' || upper(coalesce(entity_type, 'X')) || ':' || trim(name) AS canonical_id FROM p")
def cross_cloud_canonical_id(spark, d):
    rows = _parsed(spark, d).withColumn("entity_type", F.coalesce("entity_type", F.lit("x")))
    later = rows.withColumn("name", F.lit("renamed")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return entities.registered_entities(rows.unionByName(later))


@query("WITH RECURSIVE m AS (SELECT DISTINCT entity_id, epoch_us(ts) AS t0 FROM metrics), w AS (SELECT entity_id, min(t0) AS opened FROM m GROUP BY entity_id UNION ALL SELECT w.entity_id, (SELECT min(t0) FROM m WHERE m.entity_id = w.entity_id AND m.t0 >= w.opened + 86400000000) FROM w WHERE EXISTS (SELECT 1 FROM m WHERE m.entity_id = w.entity_id AND m.t0 >= w.opened + 86400000000)), s AS (SELECT entity_id, opened, lead(opened) OVER (PARTITION BY entity_id ORDER BY opened) AS until FROM w) SELECT s.entity_id, opened AS first_seen, max(epoch_us(ts)) AS last_seen, count(*) AS sightings FROM s JOIN metrics ON metrics.entity_id = s.entity_id AND epoch_us(ts) >= opened AND (until IS NULL OR epoch_us(ts) < until) GROUP BY 1, 2")
def dedup_entities(spark, d):
    rows = tables.metrics(spark, d).withColumn("raw_id", F.col("event_id").cast("string"))
    return _micros(resources.dedup_entities(rows, 86_400).drop("raw_ids"))


# Aggregation, health and detection


@query("SELECT src, dst, count(*) AS calls FROM (SELECT p.service_name AS src, c.service_name AS dst FROM traces c JOIN traces p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name AND c.ts >= TIMESTAMP '1995-01-01' AND p.ts >= TIMESTAMP '1995-01-01') GROUP BY src, dst ORDER BY calls DESC, src, dst LIMIT 500")
def busiest_edges(spark, d):
    return graph.dependency_edges(tables.traces(spark, d), F.lit("1995-01-01").cast("timestamp"), 500).select("src", "dst", "calls")


@query("SELECT (SELECT count(*) FROM incidents) AS total_incidents, (SELECT count(*) FROM anomalies WHERE status = 'active') AS active_anomalies, (SELECT count(*) FROM kb_rows) AS knowledge_base_entries")
def summary_counts(spark, d):
    return serving.summary_counts(tables.incidents(spark, d), tables.anomalies(spark, d), tables.knowledge_base(spark, d))


@query("SELECT 'metrics' AS table_name, count(*) AS rows FROM metrics UNION ALL SELECT 'incidents', count(*) FROM incidents UNION ALL SELECT 'traces', count(*) FROM traces")
def table_row_counts(spark, d):
    return serving.table_row_counts({name: getattr(tables, name)(spark, d) for name in ("metrics", "incidents", "traces")})


@query("SELECT source_ip, count(*) AS n, min(attack_type) AS attack_type, min(severity) AS severity, epoch_us(max(ts)) AS last_seen FROM anomalies WHERE source_type = 'security' AND source_ip NOT IN ('', 'unknown') GROUP BY source_ip ORDER BY n DESC, source_ip LIMIT 10")
def attack_sources(spark, d):
    return _micros(serving.attack_sources(tables.anomalies(spark, d), 10))


@query("SELECT DISTINCT entity_id FROM metrics WHERE entity_id IS NOT NULL")
def list_entities(spark, d):
    return features.list_entities(tables.metrics(spark, d))


@query("SELECT round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95, count(value) AS count FROM metrics WHERE entity_id = '7' AND metric_name = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def baseline_of(spark, d):
    day = lambda x: F.lit(x).cast("timestamp")
    return _micros(features.baseline_of(tables.metrics(spark, d), "7", "view", day("2024-01-05"), day("2024-01-20")))


@query("WITH s AS (SELECT event_id, entity_id, ts, sum(value) OVER w AS cpu, sum(value * 2 + 1) OVER w AS total FROM metrics WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, cpu - lag(cpu) OVER w AS dc, total - lag(total) OVER w AS dt FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY ts)) SELECT event_id, round(CASE WHEN dc > 0 AND dt > 0 THEN dc / dt * 2 * 100 ELSE 0 END, 4) AS cpu_percent FROM l")
def cpu_percent(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("entity_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = tables.metrics(spark, d).select("event_id", F.col("entity_id").alias("container"), "ts", F.sum("value").over(w).alias("cpu"), F.sum(F.col("value") * 2 + 1).over(w).alias("system"), F.lit(2).alias("ncpu"), F.lit(1.0).alias("used"), F.lit(2.0).alias("memory_limit"))
    return health.cpu_percent(rows).select("event_id", F.round("cpu_percent", 4).alias("cpu_percent"))


@query("SELECT entity_id, round(100.0 * count(*) FILTER (NOT is_error) / count(*), 6) AS availability, count(*) AS checks, 100.0 * count(*) FILTER (NOT is_error) / count(*) >= 80 AS met FROM metrics WHERE is_error IS NOT NULL GROUP BY entity_id")
def slo_availability(spark, d):
    rows = tables.metrics(spark, d).where("is_error is not null").select("entity_id", (~F.col("is_error")).alias("good"))
    return _micros(health.slo_availability(rows, 80.0))


@query("SELECT service_name AS entity_id, round(quantile_cont(duration_ms, 0.99), 6) AS p99, count(duration_ms) AS samples, quantile_cont(duration_ms, 0.99) < 49.5 AS met FROM traces GROUP BY service_name")
def slo_latency(spark, d):
    return _micros(health.slo_latency(tables.traces(spark, d).withColumnRenamed("service_name", "entity_id"), 49.5))


@query("WITH s AS (SELECT *, CASE WHEN value >= 3 AND value < 60 THEN 1 ELSE 0 END AS bad FROM metrics WHERE metric_name = 'view'), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT 'busy' AS rule, entity_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM g WHERE bad = 1 GROUP BY entity_id, island HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 86400000000 UNION ALL SELECT 'gone', entity_id, epoch_us(ts), epoch_us(until) FROM (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS until FROM metrics WHERE metric_name = 'error') WHERE epoch_us(until) - epoch_us(ts) > 432000000000")
def evaluate_alert_rules(spark, d):
    rows = tables.metrics(spark, d)
    flagged = rows.withColumn("value", F.when(rows.metric_name == "view", ((F.col("value") >= 3) & (F.col("value") < 60)).cast("double")).otherwise(F.col("value")))
    rules = [{"name": "busy", "metric": "view", "kind": "equals", "limit": 1.0, "seconds": 86_400}, {"name": "gone", "metric": "error", "kind": "absent", "seconds": 432_000}]
    return _micros(health.evaluate_alert_rules(flagged, rules).drop("metric_name"))


@query("SELECT 'silent' AS rule, entity_id, epoch_us(ts) AS started, epoch_us(until) AS ended FROM (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS until FROM metrics WHERE metric_name = 'error' AND ts <= TIMESTAMP '2024-02-01') WHERE epoch_us(coalesce(until, TIMESTAMP '2024-02-01')) - epoch_us(ts) > 432000000000")
def absence_until_now(spark, d):
    """Series that are silent for five days, at a given time; null ``ended``: they still are."""
    rule = {"name": "silent", "metric": "error", "kind": "absent", "seconds": 432_000}
    found = health.evaluate_alert_rules(tables.metrics(spark, d), [rule], now=dt.datetime(2024, 2, 1))
    return _micros(found.drop("metric_name"))


@query("WITH h AS (SELECT metric_name, arg_max(value, (ts, event_id)) AS last, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS s FROM metrics GROUP BY 1 HAVING count(value) >= 24) SELECT event_id, round(1 / (1 + exp(3 - abs(value - last) / s)), 6) AS seasonal_score FROM metrics LEFT JOIN h USING (metric_name)")
def seasonal_naive_score(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(detect.seasonal_naive_score(rows, rows).select("event_id", "seasonal_score"))


@query("WITH b AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1) SELECT event_id FROM metrics JOIN b USING (metric_name) WHERE metric_name = 'view' AND abs(value - m) / s >= 3 OR metric_name = 'error' AND value > 40 OR metric_name = 'click' AND value < 0.05 * m")
def metric_rules(spark, d):
    rows = tables.metrics(spark, d)
    rules = [("view", "zscore", 3.0), ("error", "above", 40.0), ("click", "below_share", 0.05)]
    return detect.metric_rules(rows, detect.zscore_baselines(rows), rules).select("event_id")


@query("WITH b AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1), z AS (SELECT event_id, entity_id, metric_name, ts, 1 / (1 + exp(3 - abs(value - m) / s)) AS score FROM metrics JOIN b USING (metric_name)), t AS (SELECT entity_id, epoch_us(ts) AS ts, max(score) AS top, arg_max(metric_name, (score, metric_name)) AS metric_name FROM z GROUP BY 1, 2) SELECT entity_id, ts, metric_name, round(top, 6) AS anomaly_score, round(top * 100, 6) AS confidence, 'performance' AS source_type FROM t WHERE top >= 0.3")
def composite_anomaly(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(seasonal.composite_anomaly(detect.zscore_score(rows, detect.zscore_baselines(rows)), ("score",), 0.3))


@query("SELECT event_id, round(coalesce(value / 100, 0) * 0.75 + coalesce(is_error::INT, 0) * 0.25, 6) AS fused FROM metrics")
def fuse_scores(spark, d):
    rows = tables.metrics(spark, d).select("event_id", (F.col("value") / 100).alias("a"), F.col("is_error").cast("double").alias("b"))
    return _micros(seasonal.fuse_scores(rows, {"a": 3, "b": 1}).select("event_id", "fused"))


@query("WITH g AS (SELECT entity_id, metric_name, epoch_us(ts) // 86400000000 AS step, avg(value) AS value FROM metrics GROUP BY 1, 2, 3), m AS (SELECT entity_id, metric_name, step % 7 AS phase, median(value) AS expected FROM g GROUP BY 1, 2, 3) SELECT entity_id, metric_name, CAST(step AS BIGINT) AS step, round(value, 6) AS value, round(expected, 6) AS expected FROM g JOIN m USING (entity_id, metric_name) WHERE step % 7 = phase")
def seasonal_expected(spark, d):
    grid = seasonal.seasonal_grid(tables.metrics(spark, d), 86_400)
    weekly = grid.select("entity_id", "metric_name").distinct().withColumn("period", F.lit(7))
    return _micros(seasonal.seasonal_predict(grid, seasonal.seasonal_fit(grid, weekly)).drop("period"))


@query("SELECT a.event_id, CASE WHEN EXISTS (SELECT 1 FROM metrics b WHERE b.entity_id = a.entity_id AND b.metric_name = 'error' AND epoch_us(a.ts) - epoch_us(b.ts) BETWEEN 0 AND 86400000000) THEN 1.5 ELSE 1.0 END AS factor FROM metrics a")
def k8s_baseline_adjustment(spark, d):
    rows = tables.metrics(spark, d)
    told = rows.where("metric_name = 'error'").select("entity_id", "ts", F.lit("Evicted").alias("reason"), F.lit("x").alias("message"))
    return seasonal.adjusted_baselines(rows, seasonal.relevant_k8s_events(told), 86_400).select("event_id", "factor")


@query("SELECT event_id, n.name AS node_name, n.id IS NOT NULL AS enriched FROM metrics LEFT JOIN nodes n ON 'n' || entity_id = n.id")
def enrich_signal(spark, d):
    rows = tables.metrics(spark, d).withColumn("entity_id", F.concat(F.lit("n"), "entity_id"))
    return seasonal.enrich_signals(rows, tables.nodes(spark, d).withColumnRenamed("entity_type", "label")).select("event_id", "node_name", "enriched")


@query()
def adwin_drift(spark, d):
    return detect.adwin_drift(tables.metrics(spark, d).withColumn("entity_id", F.lit("all")))


@query()
def retrain_on_drift(spark, d):
    rows = tables.metrics(spark, d)
    return detect.retrain_on_drift(rows, detect.adwin_drift(rows.withColumn("entity_id", F.lit("all"))), detect.zscore_baselines(rows))


@query()
def isolation_forest(spark, d):
    rows = tables.metrics(spark, d).where("value is not null").withColumn("hour", F.hour("ts"))
    return forest.forest_score(rows, ("value", "hour"), forest.fit_forest(rows, ("value", "hour"), "event_id")).select("event_id", "forest_score")


@query()
def detection_pipeline(spark, d):
    rows = tables.metrics(spark, d)
    signals, _ = detect_pipeline(rows, rows, tables.nodes(spark, d).withColumnRenamed("entity_type", "label"), threshold=0.3)
    return signals.select("event_id", "entity_id", "metric_name", F.round("fused", 9).alias("fused"), "source_type", "enriched")


# Security


@query("SELECT event_id FROM security_events WHERE regexp_matches(message, '\\b(sudo|su|escalat|role_change)', 'i') AND entity_id <> 'admin' AND entity_type <> 'ADMIN_NODE'")
def detect_priv_escalation(spark, d):
    return security.detect_priv_escalation(tables.security(spark, d)).select("event_id")


_DRIFT = "(lower(message) LIKE '%config%drift%' OR lower(message) LIKE '%config_file_changed%' OR lower(message) LIKE '%unauthorized%config%change%') AND change_id NOT IN ('chg-1', 'chg-3')"


def _approved(spark):
    return spark.createDataFrame([("chg-1",), ("chg-3",)], "change_id string")


@query(f"SELECT event_id, 'CRITICAL' AS severity FROM security_events WHERE {_DRIFT}")
def detect_config_drift(spark, d):
    return change.detect_config_drift(tables.security(spark, d), _approved(spark)).select("event_id", "severity")


_ROUTE = "CASE WHEN event_id % 5 = 0 THEN 'CONFIG_DRIFT' WHEN event_type = 'AUTH_FAILURE' THEN 'BRUTE_FORCE' WHEN event_id % 5 = 1 THEN 'PRIVILEGE_ESCALATION' WHEN outbound_bytes IS NOT NULL AND event_id % 5 = 2 THEN 'DATA_EXFILTRATION' END"


@query("WITH a AS (SELECT *, CASE event_id % 3 WHEN 0 THEN ['BRUTE_FORCE', 'CONFIG_DRIFT'] WHEN 1 THEN ['PRIVILEGE_ESCALATION', 'CONFIG_DRIFT'] ELSE ['DATA_EXFILTRATION', 'PRIVILEGE_ESCALATION'] END AS hits, " + _ROUTE + " AS route FROM security_events) SELECT event_id, CASE WHEN route IS NOT NULL THEN route WHEN event_id % 3 = 0 THEN 'BRUTE_FORCE' WHEN event_id % 3 = 1 THEN 'CONFIG_DRIFT' ELSE 'PRIVILEGE_ESCALATION' END AS attack_type FROM a WHERE route IS NULL OR list_contains(hits, route)")
def route_security(spark, d):
    """Each event has two detectors' answers; its own type says which one counts."""
    rows = tables.security(spark, d)
    names = F.when(F.col("event_id") % 5 == 0, "Unauthorized_Config change").when(F.col("event_id") % 5 == 1, "sudo shell").otherwise("odd")
    rows = rows.withColumn("attack_type", names).withColumn("outbound_bytes", F.when(F.col("event_id") % 5 == 2, F.col("outbound_bytes")))
    of = lambda *k: rows.where((F.col("event_id") % 3).isin(*k)).select("event_id")
    found = {"BRUTE_FORCE": of(0), "CONFIG_DRIFT": of(0, 1), "PRIVILEGE_ESCALATION": of(1, 2), "DATA_EXFILTRATION": of(2)}
    return change.route_security(rows, found).select("event_id", "attack_type")


@query("WITH f AS (SELECT *, count(*) OVER (PARTITION BY source_ip ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM security_events WHERE event_type = 'AUTH_FAILURE' OR lower(message) LIKE '%login%' OR lower(message) LIKE '%auth%') SELECT event_id, CASE WHEN " + _DRIFT + " THEN 'CONFIG_DRIFT' WHEN event_id IN (SELECT event_id FROM f WHERE n >= 10) THEN 'BRUTE_FORCE' ELSE 'PRIVILEGE_ESCALATION' END AS attack_type FROM security_events WHERE (" + _DRIFT + ") OR event_id IN (SELECT event_id FROM f WHERE n >= 10) OR regexp_matches(message, '\\b(sudo|su|escalat|role_change)', 'i') AND entity_id <> 'admin' AND entity_type <> 'ADMIN_NODE'")
def classify_security(spark, d):
    rows = tables.security(spark, d)
    found = {"CONFIG_DRIFT": change.detect_config_drift(rows, _approved(spark)), "BRUTE_FORCE": security.detect_brute_force(security.auth_failures(rows), 10, 86_400), "PRIVILEGE_ESCALATION": security.detect_priv_escalation(rows)}
    return change.classify_security(rows, found).select("event_id", "attack_type")


@query("SELECT event_id, coalesce(array_to_string(list(CASE WHEN message <> '' THEN message END) OVER (PARTITION BY entity_id, event_type ORDER BY ts, event_id ROWS 4 PRECEDING), '|'), '') AS evidence FROM security_events")
def aggregate_evidence(spark, d):
    rows = tables.security(spark, d).withColumnRenamed("event_type", "attack_type")
    return security.aggregate_evidence(rows).select("event_id", F.array_join("evidence", "|").alias("evidence"))


# Graph


@query("SELECT id, CASE entity_type WHEN 'SERVICE' THEN 'Service' WHEN 'DATABASE' THEN 'Database' ELSE 'Infrastructure' END AS label, name FROM nodes WHERE entity_type <> 'ODD'")
def upsert_nodes(spark, d):
    rows = tables.nodes(spark, d).select("id", "entity_type", "name", F.timestamp_seconds(F.lit(1)).alias("ts"))
    later = rows.withColumns({"name": F.lit(None).cast("string"), "ts": F.timestamp_seconds(F.lit(2))})
    return topology.upsert_nodes(rows.unionByName(later), ("name",))


@query("SELECT src, dst, 'DEPENDS_ON' AS type FROM edges WHERE layer = 1 AND dst IN (SELECT id FROM nodes)")
def build_edges(spark, d):
    ids = tables.nodes(spark, d).select("id")
    none = F.array().cast("array<string>")
    records = tables.edges(spark, d).where("layer = 1").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("depends_on")).withColumns({"calls": none, "reads_from": none})
    return topology.build_edges(records, ids)


@query("SELECT src, dst, 'CALLS' AS type, p50, CASE WHEN CAST(substr(src, 2) AS INT) % 3 > 0 THEN 'high' END AS other FROM (SELECT src, dst, max(layer) AS l, CASE CAST(substr(src, 2) AS INT) % 2 WHEN 0 THEN '1.5' ELSE '2.5' END AS p50 FROM edges WHERE layer = 1 GROUP BY src, dst) WHERE l > 0 AND CAST(substr(src, 2) AS INT) % 3 = 0 UNION ALL SELECT src, dst, 'DEPENDS_ON', NULL, 'high' FROM edges WHERE layer = 1 AND CAST(substr(src, 2) AS INT) % 3 > 0 GROUP BY src, dst")
def edge_properties(spark, d):
    """Calls keep latencies, dependencies their criticality; of two reports the later one that has a value counts."""
    rows = tables.edges(spark, d).where("layer = 1").select("src", "dst").distinct().withColumn("k", F.substring("src", 2, 20).cast("int"))
    kind = F.when(F.col("k") % 3 == 0, "CALLS").otherwise("DEPENDS_ON")
    ids = rows.select(F.col("src").alias("id"), "k").distinct()
    first = ids.select("id", F.timestamp_seconds(F.lit(1)).alias("ts"), F.lit(9.0).alias("latency_p50"), F.lit("high").alias("criticality"))
    later = ids.select("id", F.timestamp_seconds(F.lit(2)).alias("ts"), F.when(F.col("k") % 2 == 0, 1.5).otherwise(2.5).alias("latency_p50"), F.lit(None).cast("string").alias("criticality"))
    found = topology.edge_properties(first.unionByName(later), rows.select("src", "dst", kind.alias("type")))
    return found.select("src", "dst", "type", F.element_at("properties", "latency_p50").alias("p50"), F.element_at("properties", "criticality").alias("other"))


@query("SELECT dst AS neighbor, 'out' AS direction FROM edges WHERE src = 'n3' UNION ALL SELECT src, 'in' FROM edges WHERE dst = 'n3'")
def neighbors(spark, d):
    return graph.neighbors(tables.edges(spark, d), "n3")


@query("WITH e AS (SELECT * FROM edges UNION ALL SELECT dst, src, 2 FROM edges WHERE layer = 1 AND CAST(substr(src, 2) AS INT) % 5 = 0) SELECT src, dst, layer FROM e WHERE layer = 2 OR NOT EXISTS (SELECT 1 FROM e f WHERE f.layer = 2 AND (f.src = e.src AND f.dst = e.dst OR f.src = e.dst AND f.dst = e.src))")
def merge_layers(spark, d):
    rows = tables.edges(spark, d)
    extra = rows.where((F.col("layer") == 1) & (F.substring("src", 2, 20).cast("int") % 5 == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2).alias("layer"))
    return graph.merge_layers(rows.unionByName(extra))


_PATHS = "RECURSIVE u AS (SELECT CASE WHEN layer = 1 THEN src ELSE dst END AS node, CASE WHEN layer = 1 THEN dst ELSE src END AS up, layer = 2 AS strong FROM edges), w AS (SELECT id AS symptom, id AS node, id AS path, 1 AS n, false AS causal FROM nodes UNION ALL SELECT symptom, up, up || '>' || path, n + 1, causal OR strong FROM w JOIN u ON w.node = u.node WHERE n < 10), p AS (SELECT symptom, node AS root, path, n, causal FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.node = w.node))"


def _fault_paths(spark, d):
    return graph.fault_paths(tables.edges(spark, d), tables.nodes(spark, d).select(F.col("id").alias("symptom")))


@query(f"WITH {_PATHS} SELECT symptom, root, path, causal FROM p")
def fault_paths(spark, d):
    return _fault_paths(spark, d).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_PATHS} SELECT symptom, root, round(CASE WHEN n = 1 THEN 0.2 ELSE CASE WHEN causal THEN 0.85 ELSE 0.55 END * (0.6 + 0.4 * greatest(0, 1 - 0.12 * (n - 1))) END, 3) AS confidence, 1 AS rank FROM p WHERE n > 1")
def score_root_causes(spark, d):
    return graph.score_root_causes(_fault_paths(spark, d))


@query(f"WITH {_PATHS} SELECT symptom, root, causal, min(n) AS n, arg_min(path, (n, path)) AS path FROM p GROUP BY symptom, root, causal")
def best_paths(spark, d):
    found = graph.best_paths(tables.edges(spark, d), tables.nodes(spark, d).select(F.col("id").alias("symptom")))
    return found.select("symptom", "root", "causal", F.size("path").alias("n"), F.array_join("path", ">").alias("path"))


@query(f"WITH {_PATHS}, s AS (SELECT 'n' || entity_id AS symptom, count(*) AS points, max(value) AS score FROM metrics GROUP BY 1) SELECT symptom, CASE WHEN n > 1 THEN root ELSE symptom END AS root_cause_entity, CASE WHEN n > 1 THEN round(CASE WHEN causal THEN 0.85 ELSE 0.55 END * (0.6 + 0.4 * greatest(0, 1 - 0.12 * (n - 1))), 3) ELSE 0 END AS confidence, score AS anomaly_score, points FROM s LEFT JOIN p USING (symptom)")
def build_root_cause(spark, d):
    signals = tables.metrics(spark, d).select(F.concat(F.lit("n"), "entity_id").alias("symptom"), "ts", "metric_name", F.col("value").alias("score"))
    found = topology.build_root_causes(signals, graph.score_root_causes(_fault_paths(spark, d)))
    return found.select("symptom", "root_cause_entity", "confidence", "anomaly_score", F.size("evidence").cast("long").alias("points"))


@query("SELECT event_id, CASE WHEN 'n' || entity_id IN (SELECT id FROM nodes) THEN 'n' || entity_id WHEN user_id % 2 = 0 THEN 'gcp:eu:VM:n' || entity_id ELSE 'n' || entity_id END AS symptom FROM (SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE user_id IS NOT NULL)")
def resolve_symptom(spark, d):
    signals = tables.metrics(spark, d).where("entity_id is not null").select("event_id", F.concat(F.lit("n"), "entity_id").alias("entity_id"), F.lit("GCP").alias("provider"), F.lit("eu").alias("region"), F.lit("vm").alias("entity_type"))
    even = signals.where(F.substring("entity_id", 2, 20).cast("int") % 2 == 0).select(F.concat(F.lit("gcp:eu:VM:"), "entity_id").alias("id")).distinct()
    ids = tables.nodes(spark, d).select("id").unionByName(even)
    return topology.resolve_symptoms(signals, ids).select("event_id", "symptom")


@query("SELECT id, anomaly_score FROM nodes WHERE anomaly_score IS NOT NULL ORDER BY anomaly_score DESC, id LIMIT 10")
def top_entities(spark, d):
    return graph.top_entities(tables.nodes(spark, d)).select("id", "anomaly_score")


_DAYS = "h AS (SELECT entity_id, metric_name, epoch_us(date_trunc('day', ts)) // 86400000000 AS idx, sum(value) AS v FROM metrics GROUP BY 1, 2, 3)"


def _days(spark, d):
    day = (F.unix_micros(F.date_trunc("day", "ts")) / 86_400_000_000).cast("long")
    return tables.metrics(spark, d).groupBy("entity_id", "metric_name", day.alias("idx")).agg(F.sum("value").alias("value"))


@query(f"WITH {_DAYS}, l AS (SELECT a.entity_id, b.idx, a.v AS x, b.v AS y FROM h a JOIN h b ON a.entity_id = b.entity_id AND a.metric_name = 'view' AND b.metric_name = 'click' AND b.idx = a.idx + 2), r AS (SELECT a.entity_id, b.idx, a.v AS x, b.v AS y FROM h a JOIN h b ON a.entity_id = b.entity_id AND a.metric_name = 'view' AND b.metric_name = 'click' AND b.idx = a.idx), f AS (SELECT entity_id FROM l GROUP BY 1 HAVING count(*) >= 3) SELECT entity_id, idx, round(x, 6) AS x, round(y, 6) AS y, 2 AS lag FROM l WHERE entity_id IN (SELECT entity_id FROM f) UNION ALL SELECT entity_id, idx, round(x, 6), round(y, 6), 0 FROM r WHERE entity_id NOT IN (SELECT entity_id FROM f)")
def align_by_lag(spark, d):
    series = _days(spark, d).where("entity_id is not null")
    pairs = series.select("entity_id").distinct().select("entity_id", F.lit("view").alias("cause"), F.lit("click").alias("effect"), F.lit(2).alias("lag"))
    return _micros(topology.align_by_lag(series, pairs).select("entity_id", F.col("idx").cast("long").alias("idx"), "x", "y", "lag"))


@query(f"WITH {_DAYS}, c AS (SELECT a.entity_id, a.metric_name, abs(corr(a.v, b.v)) AS r FROM h a JOIN h b ON a.entity_id = b.entity_id AND a.idx = b.idx AND b.metric_name = 'error' AND a.metric_name <> 'error' GROUP BY 1, 2 HAVING stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0) SELECT entity_id, metric_name, round(r, 6) AS r FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(r, 9) DESC, metric_name) <= 2")
def correlation_root_ranking(spark, d):
    series = _days(spark, d)
    marked = series.where("metric_name = 'error'").select("entity_id", "metric_name").distinct()
    return _micros(topology.correlation_ranking(series, marked, 2).drop("rank"))


# Incidents, policy and learning

_GRADED = "s AS (SELECT *, len(impacted_services) AS n, CASE WHEN entity_type LIKE '%DATABASE%' AND confidence >= 85 AND len(impacted_services) >= 3 THEN 'P1' WHEN confidence >= 70 OR anomaly_score >= 0.7 THEN 'P2' WHEN confidence >= 40 OR anomaly_score >= 0.4 THEN 'P3' ELSE 'P4' END AS severity FROM root_causes), i AS (SELECT *, least(100, least(40, anomaly_score * 40) + least(25, 5 * n) + least(15, confidence * 0.15) + CASE severity WHEN 'P1' THEN 20 WHEN 'P2' THEN 15 WHEN 'P3' THEN 10 ELSE 5 END + least(10, 2 * len(fault_path)) + least(5, len(log_snippets))) AS impact FROM s)"


@query(f"WITH {_GRADED} SELECT incident_id, severity, round(impact, 6) AS impact, CASE WHEN impact >= 80 OR severity = 'P1' THEN 'HIGH' WHEN impact >= 50 OR severity = 'P2' THEN 'MEDIUM' ELSE 'LOW' END AS sla_breach_risk, CASE WHEN severity = 'P1' AND confidence >= 85 THEN 'auto-remediation' ELSE 'oncall-engineer' END AS assigned_to, '[' || array_to_string(['\"' || x || '\"' FOR x IN impacted_services], ',') || ']' AS impacted_services FROM i")
def build_incidents(spark, d):
    return _micros(policy.build_incidents(tables.root_causes(spark, d)).select("incident_id", "severity", "impact", "sla_breach_risk", "assigned_to", "impacted_services"))


_ACTIONS = "a AS (SELECT * FROM (VALUES ('API_NODE', ['restart_service', 'scale_deployment', 'clear_cache', 'kill_pod', 'rollback', 'block_ip']), ('DATABASE_NODE', ['restart_service', 'rollback', 'clear_cache', 'rotate_credentials']), ('SERVICE', ['restart_service', 'scale_deployment', 'kill_pod', 'rollback']), ('K8S_RESOURCE', ['kill_pod', 'scale_deployment']), ('INFRASTRUCTURE', ['restart_service', 'clear_cache'])) v(entity_type, names)), x AS (SELECT entity_type, unnest(names) AS action_type, unnest(range(len(names))) AS position FROM a)"
_DECIDED = f"{_GRADED}, {_ACTIONS}, q AS (SELECT incident_id, action_type, position, action_type IN ('block_ip', 'rotate_credentials') AS human, severity IN ('P1', 'P2') AND confidence > 95 AS strong FROM i JOIN x USING (entity_type)), d AS (SELECT incident_id, action_type, position, strong AND NOT human AS allow, human OR NOT strong AS needs_approval FROM q)"


def _decisions(spark, d):
    rows = policy.build_incidents(tables.root_causes(spark, d))
    return rows, policy.policy_decisions(rows, policy.action_registry(spark))


@query(f"WITH {_DECIDED} SELECT incident_id, action_type, allow, needs_approval FROM d")
def policy_decisions(spark, d):
    return _decisions(spark, d)[1].select("incident_id", "action_type", "allow", "needs_approval")


_ROUTED = f"{_DECIDED}, r AS (SELECT incident_id, arg_min(action_type, (NOT allow, position)) AS action_type, CASE WHEN max(allow) THEN 'auto' ELSE 'approval' END AS route FROM d WHERE allow OR needs_approval GROUP BY incident_id)"


@query(f"WITH {_ROUTED} SELECT incident_id, action_type, route FROM r")
def route_actions(spark, d):
    return policy.route_actions(*_decisions(spark, d))


@query(f"WITH {_ROUTED} SELECT 'apr-' || substr(sha256(incident_id || '|' || action_type), 1, 12) AS approval_id, incident_id, action_type, 'orchestrator' AS proposed_by, 'pending' AS status FROM r WHERE route = 'approval'")
def pending_approvals(spark, d):
    return policy.pending_approvals(policy.route_actions(*_decisions(spark, d)))


@query("SELECT approval_id, epoch_us(created_at) AS created_at FROM approvals WHERE status = 'pending' ORDER BY approvals.created_at DESC, approval_id LIMIT 100")
def list_approvals(spark, d):
    return _micros(policy.list_approvals(tables.approvals(spark, d)).select("approval_id", "created_at"))


@query("SELECT approval_id, CASE WHEN status = 'pending' AND incident_id % 2 = 0 THEN 'approved' ELSE status END AS status FROM approvals")
def decide_approvals(spark, d):
    rows = tables.approvals(spark, d)
    first = rows.where("incident_id % 2 = 0").select("approval_id", F.lit("rejected").alias("status"), F.timestamp_seconds(F.lit(1)).alias("decided_at"))
    second = first.withColumns({"status": F.lit("approved"), "decided_at": F.timestamp_seconds(F.lit(2))})
    return policy.decide_approvals(rows, first.unionByName(second)).select("approval_id", "status")


@query("SELECT 'kb-' || incident_id AS kb_id, action_type || ' on ' || approval_id || CASE WHEN status = 'approved' THEN ' succeeded' ELSE ' failed' END AS resolution_summary, '[\"' || action_type || '\"]' AS actions_taken, CASE WHEN status = 'approved' THEN 'success' ELSE 'failure' END AS outcome, CAST(status = 'approved' AS BIGINT) AS success_count FROM approvals")
def feedback_to_kb(spark, d):
    rows = tables.approvals(spark, d).select(F.col("incident_id").alias("action_id"), "incident_id", F.col("approval_id").alias("entity_id"), "action_type", (F.col("status") == "approved").alias("success"))
    return policy.feedback_to_knowledge(rows).select("kb_id", "resolution_summary", "actions_taken", "outcome", "success_count")


@query("SELECT incident_id, CASE WHEN impact > 80 THEN 'AT RISK' WHEN severity = 'P1' THEN 'BREACH IMMINENT' ELSE 'COMPLIANT' END AS state, count(l_orderkey) AS n_audit FROM incidents LEFT JOIN lineitem ON l_orderkey = incident_id GROUP BY 1, 2")
def compliance_status(spark, d):
    rows = tables.incidents(spark, d).withColumn("risk", F.when(F.col("severity") == "P1", "HIGH").otherwise("LOW"))
    return policy.compliance_status(rows, tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("incident_id")))


@query("SELECT incident_id, CASE WHEN incident_id % 3 = 0 THEN 'ghost-' || (incident_id % 7) ELSE '' END AS hallucinated, incident_id % 3 <> 0 AS valid FROM incidents")
def grounding_check(spark, d):
    rows = tables.incidents(spark, d)
    body = F.concat(F.lit('{"summary":"restart db_'), "incident_id", F.lit('"'), F.when(F.col("incident_id") % 3 == 0, F.concat(F.lit(',"next":"ghost-'), F.col("incident_id") % 7, F.lit('"'))).otherwise(""), F.lit("}"))
    known = rows.select("incident_id", F.concat(F.lit("DB-"), "incident_id").alias("entity"))
    found = policy.grounding_check(policy.artefact_names(rows.select("incident_id", body.alias("body"))), known)
    return found.select("incident_id", F.array_join("hallucinated", ",").alias("hallucinated"), "valid")


# Serving


@query("SELECT anomaly_id FROM anomalies WHERE entity_id = '7' AND source_type = 'security' AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts DESC, anomaly_id, attack_type LIMIT 50")
def list_anomalies(spark, d):
    return serving.newest(tables.anomalies(spark, d), "ts", 50, F.lit("2024-01-03").cast("timestamp"), entity_id="7", source_type="security").select("anomaly_id")


@query("SELECT event_id FROM metrics WHERE entity_id = '7' AND metric_name = 'view' ORDER BY ts DESC, event_id LIMIT 1000")
def list_metrics(spark, d):
    return serving.newest(tables.metrics(spark, d), "ts", 1000, most=1000, entity_id="7", metric_name="view").select("event_id")


@query("SELECT event_id FROM metrics WHERE is_error AND entity_id = '7' ORDER BY ts DESC, entity_id, event_id LIMIT 500")
def list_logs(spark, d):
    return serving.newest(tables.logs(spark, d), "ts", 9999, entity_id="7", log_level="ERROR").select("event_id")


@query("SELECT trace_id, CAST(span_id AS VARCHAR) AS span_id FROM traces WHERE service_name = 'svc-3' ORDER BY ts DESC, duration_ms, CASE WHEN parent_span_id = 0 THEN '' ELSE CAST(parent_span_id AS VARCHAR) END, service_name, CAST(span_id AS VARCHAR), trace_id LIMIT 50")
def list_traces(spark, d):
    return serving.newest(tables.traces(spark, d), "ts", service_name="svc-3").select("trace_id", "span_id")


@query("SELECT incident_id FROM incidents WHERE root_cause_entity = '7' ORDER BY created_at DESC, impact, incident_id LIMIT 50")
def select_by_entity(spark, d):
    return serving.select_by_entity({"incidents": tables.incidents(spark, d), "metrics": tables.metrics(spark, d)}, "incidents", "7").select("incident_id")


@query("SELECT kb_id FROM kb_rows WHERE contains(root_cause_entity, 'URG') OR contains(resolution_summary, 'URG') ORDER BY created_at DESC, kb_id LIMIT 50")
def search_knowledge(spark, d):
    return serving.search_knowledge(tables.knowledge_base(spark, d), "URG").select("kb_id")


@query("SELECT anomaly_id FROM anomalies WHERE source_type = 'security' ORDER BY ts DESC, anomaly_id LIMIT 50")
def security_anomalies(spark, d):
    return serving.security_anomalies(tables.anomalies(spark, d)).select("anomaly_id")


@query("SELECT * FROM (SELECT kb_id AS id FROM kb_rows ORDER BY created_at DESC, kb_id LIMIT 20) UNION ALL SELECT * FROM (SELECT approval_id FROM approvals WHERE status <> 'pending' ORDER BY decided_at DESC, action_type, approval_id LIMIT 20)")
def remediation_history(spark, d):
    kb, decided = serving.remediation_history(tables.knowledge_base(spark, d), tables.approvals(spark, d), 20)
    return kb.select(F.col("kb_id").alias("id")).unionByName(decided.select(F.col("approval_id").alias("id")))


@query("WITH o AS (SELECT id FROM nodes WHERE workspace = 'team-a') SELECT src, dst FROM edges WHERE src IN (SELECT id FROM o) AND dst IN (SELECT id FROM o)")
def workspace_filter(spark, d):
    return change.workspace_graph(tables.nodes(spark, d), tables.edges(spark, d), "team-a", "team-a")[1].select("src", "dst")


@query("SELECT severity, count(*) AS n FROM incidents GROUP BY severity")
def safe_sql(spark, d):
    tables.incidents(spark, d).createOrReplaceTempView("incidents_asked")
    return serving.safe_sql(spark, "SELECT severity, count(*) AS n FROM incidents_asked GROUP BY severity")[0]


@query("SELECT o_orderkey AS incident_id, name FROM (SELECT o_orderkey, unnest(['svc-' || (o_custkey % 50), lower(o_orderstatus), 'line \"one\"', lower(o_orderpriority)]) AS name FROM orders) WHERE name NOT IN ('1-urgent', '2-high', '3-medium', '4-not specified', '5-low') GROUP BY ALL")
def artefact_entities(spark, d):
    """Values of generated JSON; priorities and a sentence go by the words of a table made from the data."""
    o = tables.table(spark, d, "orders")
    body = F.to_json(F.struct(F.concat(F.lit(" svc-"), F.col("o_custkey") % 50).alias("service"), F.array(F.col("o_orderstatus"), F.lit('Line "one"'), F.col("o_orderpriority")).alias("list"), F.struct(F.lit("a urgent matter").alias("text"), F.lit("--").alias("mark")).alias("inner")))
    filler = o.select(F.explode(F.split(F.lower("o_orderpriority"), " ")).alias("word")).distinct().union(o.select(F.lit("urgent").alias("word")).distinct())
    return policy.artefact_entities(o.select(F.col("o_orderkey").alias("incident_id"), body.alias("body")), filler)


@query("SELECT event_id, workspace FROM (SELECT event_id, 'team-' || (user_id % 3) AS workspace, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 150")
def recent_per_workspace(spark, d):
    e = tables.table(spark, d, "events").select("event_id", F.concat(F.lit("team-"), F.col("user_id") % 3).alias("workspace"), "ts")
    return serving.recent_per_entity(e, 150, "workspace").select("event_id", "workspace")


@query("SELECT src, dst, calls, round(p50, 6) AS latency_p50 FROM (SELECT p.service_name AS src, c.service_name AS dst, count(*) AS calls, quantile_cont(c.duration_ms, 0.5) AS p50 FROM traces c JOIN traces p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name GROUP BY 1, 2)")
def topology_export(spark, d):
    """The call graph of the traces, exported as edges with their latency."""
    calls = graph.dependency_edges(tables.traces(spark, d)).withColumnRenamed("p50", "latency_p50").withColumn("type", F.lit("CALLS"))
    ids = calls.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.lit("Service"))
    _, edges = topology.topology_export(ids, calls)
    return _micros(edges.join(calls.select("src", "dst", "calls"), ["src", "dst"]).select("src", "dst", "calls", "latency_p50"))
