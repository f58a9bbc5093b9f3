"""Registered queries of the observability operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import detect, entities, features, graph, incidents, security, serving
from .sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The tables of ``sources.tables`` as SQL.
VIEWS = {
    "metrics": "SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, event_type AS metric_name, value, ts, event_type = 'error' AS is_error FROM events",
    "traces": "SELECT l_orderkey AS trace_id, n AS span_id, n - 1 AS parent_span_id, 'svc-' || l_suppkey AS service_name, l_quantity AS duration_ms, l_shipdate AS ts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)",
    "incidents": "SELECT o_orderkey AS incident_id, CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN 'P' || o_orderpriority[1] ELSE 'P4' END AS severity, CAST(o_custkey AS VARCHAR) AS root_cause_entity, o_totalprice / 5000 AS impact, o_orderstatus AS status, o_orderdate AS created_at FROM orders",
    "knowledge": "SELECT CAST(l_suppkey AS VARCHAR) AS root_cause_entity, l_returnflag AS outcome, l_linestatus AS action_type, l_linenumber AS success_count FROM lineitem",
}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL over the tables and VIEWS."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [v for v in VIEWS if f" {v}" in sql]
            head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
            views = head + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            SQL[f.__name__] = (views + (", " if sql.startswith(head) else " ") + sql.removeprefix(head)) if used else sql
        return f

    return add


def _micros(df: DataFrame) -> DataFrame:
    """Times as microseconds and doubles rounded, so that any engine's rows compare."""
    out = []
    for name, kind in df.dtypes:
        out.append(F.unix_micros(name).alias(name) if kind == "timestamp" else F.round(name, 6).alias(name) if kind == "double" else F.col(name))
    return df.select(*out)


@query("SELECT entity_id, metric_name, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) + 300000000 AS window_end, '5 minutes' AS window_size, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, count(value) AS count, round(sum(value), 6) AS sum, round(sum(is_error::INT) / count(value), 6) AS error_rate FROM metrics GROUP BY entity_id, metric_name, time_bucket(INTERVAL 5 MINUTE, ts)")
def tumbling_features(spark, d):
    return _micros(features.tumbling_features(tables.metrics(spark, d)))


@query("WITH w AS (SELECT *, unnest(generate_series(0, 4)) AS k FROM metrics), x AS (SELECT *, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) - k * 60000000 AS s FROM w) SELECT entity_id, metric_name, s AS window_start, s + 300000000 AS window_end, '5 minutes' AS window_size, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, count(value) AS count, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS stddev, round(count(value) / 300, 6) AS rate FROM x GROUP BY entity_id, metric_name, s")
def sliding_features(spark, d):
    return _micros(features.sliding_features(tables.metrics(spark, d)))


@query("WITH w AS (SELECT *, unnest(generate_series(0, 4)) AS k FROM metrics), x AS (SELECT *, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) - k * 60000000 AS s FROM w) SELECT entity_id, metric_name, s AS window_start, s + 300000000 AS window_end, '5 minutes' AS window_size, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, count(value) AS count, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS stddev, round(count(value) / 300, 6) AS rate FROM x GROUP BY entity_id, metric_name, s")
def sliding_by_panes(spark, d):
    return _micros(features.sliding_by_panes(tables.metrics(spark, d)))


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS o FROM metrics), i AS (SELECT *, sum(o) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT entity_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 3600000000 AS session_end, count(*) AS events, CAST(sum(is_error::INT) AS BIGINT) AS errors, sum(is_error::INT) > 3 AS burst FROM i GROUP BY entity_id, s")
def session_bursts(spark, d):
    return _micros(features.session_bursts(tables.metrics(spark, d), "1 hour"))


_WINDOWS = "t AS (SELECT entity_id, metric_name, '{n} minutes' AS window_size, epoch_us(time_bucket(INTERVAL {n} MINUTE, ts)) AS s, epoch_us(time_bucket(INTERVAL {n} MINUTE, ts)) + {n} * 60000000 AS e, min(value) AS lo, max(value) AS hi, avg(value) AS a, count(value) AS c, sum(is_error::INT) / count(value) AS er FROM metrics GROUP BY 1, 2, 4)"


@query("WITH " + _WINDOWS.format(n=5) + ", " + _WINDOWS.format(n=15).replace("t AS", "l AS") + ", b AS (FROM t UNION ALL FROM l) SELECT entity_id, window_size, metric_name, e AS window_end, min(s) OVER w AS first_start, CAST(NULL AS DOUBLE) AS latency_p50, CAST(NULL AS DOUBLE) AS latency_p95, CAST(NULL AS DOUBLE) AS latency_p99, round(last_value(er IGNORE NULLS) OVER w, 6) AS error_rate, round(sum(a * c) OVER w / sum(c) OVER w, 6) AS latency_avg, round(min(lo) OVER w, 6) AS latency_min, round(max(hi) OVER w, 6) AS latency_max, CAST(sum(c) OVER w AS BIGINT) AS request_volume, count(*) OVER v AS feature_version, 90 AS ttl FROM b WINDOW w AS (PARTITION BY entity_id, window_size ORDER BY e, s, metric_name ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY entity_id ORDER BY e, s, metric_name, window_size ROWS UNBOUNDED PRECEDING)")
def feature_vectors(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(features.feature_vectors(features.tumbling_features(rows).unionByName(features.tumbling_features(rows, "15 minutes"))))


@query("SELECT entity_id, metric_name, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS count FROM metrics GROUP BY entity_id, metric_name")
def metrics_baseline(spark, d):
    return _micros(features.metrics_baseline(tables.metrics(spark, d)))


@query("SELECT entity_id, metric_name, epoch_us(date_trunc('hour', ts)) AS hour, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS count FROM metrics GROUP BY entity_id, metric_name, date_trunc('hour', ts)")
def hourly_timeseries(spark, d):
    return _micros(features.hourly_timeseries(tables.metrics(spark, d)))


@query("SELECT src, dst, count(*) AS calls, round(avg(d), 6) AS avg_ms, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT p.service_name AS src, c.service_name AS dst, c.duration_ms AS d FROM traces c JOIN traces p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name) GROUP BY src, dst")
def dependency_edges(spark, d):
    return _micros(graph.dependency_edges(tables.traces(spark, d)))


@query("SELECT severity, count(*) AS n FROM incidents GROUP BY severity")
def severity_distribution(spark, d):
    return serving.severity_distribution(tables.incidents(spark, d))


@query("SELECT epoch_us(date_trunc('hour', created_at)) AS hour, severity, count(*) AS n FROM incidents GROUP BY date_trunc('hour', created_at), severity")
def incidents_timeline(spark, d):
    return _micros(serving.incidents_timeline(tables.incidents(spark, d)))


@query("SELECT outcome, action_type, CAST(grouping(outcome, action_type) AS BIGINT) AS level, count(*) AS n FROM knowledge GROUP BY GROUPING SETS ((), (outcome), (action_type))")
def knowledge_stats(spark, d):
    return serving.knowledge_stats(tables.knowledge(spark, d))


@query("SELECT entity_id, metric_name, epoch_us(max(ts)) AS last_seen FROM metrics GROUP BY entity_id, metric_name")
def last_seen_activity(spark, d):
    return _micros(serving.last_seen(tables.metrics(spark, d)))


@query("SELECT event_id, entity_id FROM metrics QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) <= 150")
def recent_logs_per_entity(spark, d):
    return serving.recent_per_entity(tables.logs(spark, d)).select("event_id", "entity_id")


@query("SELECT incident_id, severity, root_cause_entity, round(impact, 6) AS impact, status, epoch_us(created_at) AS created_at FROM incidents WHERE severity = 'P1' ORDER BY incidents.created_at DESC, incidents.impact, incident_id LIMIT 50")
def list_incidents(spark, d):
    return _micros(serving.newest(tables.incidents(spark, d), "created_at", severity="P1"))


@query("SELECT root_cause_entity, severity, epoch_us(date_trunc('hour', created_at)) AS bucket, count(*) AS pattern_count, epoch_us(min(created_at)) AS first_seen, epoch_us(max(created_at)) AS last_seen, 'pat-' || substr(sha256(root_cause_entity || '|' || severity || '|' || strftime(date_trunc('hour', created_at)::TIMESTAMP, '%Y-%m-%d %H:%M:%S')), 1, 12) AS pattern_id FROM incidents GROUP BY root_cause_entity, severity, date_trunc('hour', created_at) HAVING count(*) >= 2")
def mine_incident_patterns(spark, d):
    return _micros(incidents.mine_patterns(tables.incidents(spark, d)))


@query("WITH t AS (SELECT root_cause_entity, action_type, CAST(sum(success_count) AS BIGINT) AS total FROM knowledge WHERE outcome = 'A' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY root_cause_entity ORDER BY total DESC, action_type) AS rank FROM t) SELECT root_cause_entity, action_type, total, CAST(rank AS INT) AS rank, round(total / sum(total) OVER (PARTITION BY root_cause_entity) * 100, 1) AS confidence FROM r WHERE rank <= 3")
def recommend_actions(spark, d):
    return incidents.recommend_actions(tables.knowledge(spark, d), "A")


@query("WITH b AS (SELECT metric_name, avg(value) AS m, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS s FROM metrics GROUP BY 1) SELECT event_id, round(abs(value - m) / s, 6) AS z, round(1 / (1 + exp(3 - abs(value - m) / s)), 6) AS score, round(abs(value - m) / s - 3, 6) AS deviation FROM metrics JOIN b USING (metric_name)")
def zscore_score(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(detect.zscore_score(rows, detect.zscore_baselines(rows)).select("event_id", "z", "score", "deviation"))


@query("SELECT event_id, round(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w + 3 * stddev_pop(value) OVER w END, 6) AS threshold FROM metrics WINDOW w AS (PARTITION BY entity_id, metric_name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def adaptive_threshold(spark, d):
    return _micros(detect.adaptive_threshold(tables.metrics(spark, d)).select("event_id", "threshold"))


@query("WITH b AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1), r AS (SELECT event_id, entity_id, metric_name, ts, sum((value - m) / s - 0.5) OVER w AS up, sum(-(value - m) / s - 0.5) OVER w AS down FROM metrics JOIN b USING (metric_name) WINDOW w AS (PARTITION BY entity_id, metric_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, round(up - least(0, min(up) OVER v), 6) AS s_pos, round(down - least(0, min(down) OVER v), 6) AS s_neg FROM r WINDOW v AS (PARTITION BY entity_id, metric_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cusum_drift(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(detect.cusum_drift(rows, detect.zscore_baselines(rows)).select("event_id", "s_pos", "s_neg"))


@query("WITH b AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1), r AS (SELECT event_id, metric_name, ts, sum((value - m) / s - 0.5) OVER w AS up, sum(-(value - m) / s - 0.5) OVER w AS down FROM metrics JOIN b USING (metric_name) WINDOW w AS (PARTITION BY metric_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, round(up - least(0, min(up) OVER v), 6) AS s_pos, round(down - least(0, min(down) OVER v), 6) AS s_neg FROM r WINDOW v AS (PARTITION BY metric_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cusum_by_pieces(spark, d):
    """One series for each metric, cut into pieces of time."""
    rows = tables.metrics(spark, d).withColumn("entity_id", F.lit("all"))
    return _micros(detect.cusum_drift(rows, detect.zscore_baselines(rows), block=1000).select("event_id", "s_pos", "s_neg"))


_SCORES = "WITH b AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1), z AS (SELECT event_id, entity_id, metric_name, ts, 1 / (1 + exp(3 - abs(value - m) / s)) AS score FROM metrics JOIN b USING (metric_name))"


@query(_SCORES + " SELECT event_id, score >= 0.85 OR epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY entity_id, metric_name) >= 180000000 AS keep FROM z")
def suppress_noise(spark, d):
    rows = tables.metrics(spark, d)
    return detect.suppress_noise(detect.zscore_score(rows, detect.zscore_baselines(rows))).select("event_id", "keep")


@query(_SCORES + ", c AS (SELECT *, CASE WHEN max(score) OVER w < 0.5 AND count(score) OVER w = 3 THEN 1 ELSE 0 END AS closes FROM z WINDOW w AS (PARTITION BY entity_id, metric_name ORDER BY ts, event_id ROWS 2 PRECEDING)), s AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY entity_id, metric_name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM c) SELECT entity_id, metric_name, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, round(max(score), 6) AS peak, count(*) AS points, max(closes) = 1 AS resolved, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s FROM s GROUP BY entity_id, metric_name, session")
def anomaly_sessions(spark, d):
    rows = tables.metrics(spark, d)
    return _micros(detect.anomaly_sessions(detect.zscore_score(rows, detect.zscore_baselines(rows))))


@query("WITH r AS (SELECT event_id, entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS failures FROM metrics WHERE is_error) SELECT event_id, failures, least(2 * failures, 100) AS confidence, 'brute-force-' || entity_id AS entity FROM r WHERE failures >= 3")
def detect_brute_force(spark, d):
    rows = tables.metrics(spark, d).where("is_error").withColumnRenamed("entity_id", "source_ip")
    return security.detect_brute_force(rows, n=3, seconds=86_400).select("event_id", "failures", "confidence", "entity")


@query("WITH r AS (SELECT a.event_id, a.value, avg(b.value) AS baseline FROM metrics a JOIN metrics b ON a.entity_id = b.entity_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 86400000000 AND epoch_us(a.ts) AND (b.ts < a.ts OR b.event_id < a.event_id) GROUP BY a.event_id, a.value) SELECT event_id, round(baseline, 6) AS baseline FROM r WHERE baseline > 0 AND value > 3 * baseline")
def detect_data_exfil(spark, d):
    rows = tables.metrics(spark, d).withColumnRenamed("value", "outbound_bytes")
    return _micros(security.detect_data_exfil(rows, seconds=86_400).select("event_id", "baseline"))


@query("SELECT incident_id, round(impact, 6) AS impact, CASE WHEN impact >= 80 THEN 'HIGH' WHEN severity = 'P1' THEN 'HIGH' WHEN impact >= 50 OR severity = 'P2' THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN severity = 'P1' AND impact >= 85 THEN 'auto-remediation' ELSE 'oncall-engineer' END AS owner FROM incidents")
def sla_risk(spark, d):
    rows = tables.incidents(spark, d)
    return _micros(rows.select("incident_id", "impact", incidents.sla_risk(F.col("severity"), F.col("impact")).alias("risk"), incidents.assign_owner(F.col("severity"), F.col("impact")).alias("owner")))


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(created_at) - lag(epoch_us(created_at)) OVER w <= 864000000000 THEN 0 ELSE 1 END AS o FROM incidents WINDOW w AS (PARTITION BY root_cause_entity ORDER BY created_at, incident_id)), i AS (SELECT *, sum(o) OVER (PARTITION BY root_cause_entity ORDER BY created_at, incident_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT root_cause_entity, arg_min(incident_id, (created_at, incident_id)) AS incident_id, epoch_us(min(created_at)) AS created_at, count(*) AS deduplicated_count, round(max(impact), 6) AS impact, array_to_string(list_sort(list(incident_id)), ',') AS related_incidents FROM i GROUP BY root_cause_entity, s")
def dedup_incidents(spark, d):
    return _micros(incidents.dedup_incidents(tables.incidents(spark, d), 864_000).drop("island")).withColumn("related_incidents", F.array_join(F.col("related_incidents").cast("array<string>"), ","))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations")
def clean_log_body(spark, d):
    return tables.table(spark, d, "conversations").select("conv_id", "turn", N.log_body(F.col("text")).alias("body"))


@query("SELECT p_partkey, round(CASE WHEN p_type LIKE '%by%' OR lower(p_type) LIKE '%byte%' THEN p_retailprice / 1048576 WHEN lower(p_type) LIKE '%ms%' OR lower(p_type) LIKE '%milli%' THEN p_retailprice / 1e3 WHEN lower(p_type) LIKE '%us%' OR lower(p_type) LIKE '%micro%' THEN p_retailprice / 1e6 WHEN lower(p_type) LIKE '%ns%' OR lower(p_type) LIKE '%nano%' THEN p_retailprice / 1e9 ELSE p_retailprice END, 6) AS value FROM part")
def normalize_metric_units(spark, d):
    return _micros(tables.table(spark, d, "part").select("p_partkey", N.metric_value(F.col("p_retailprice"), F.col("p_type")).alias("value")))


@query("SELECT c.trace_id, c.span_id AS child_span, p.service_name AS src, c.service_name AS dst, 'CALLS' AS type, c.duration_ms AS latency_ms FROM traces c JOIN traces p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 2592000000000")
def build_relationships(spark, d):
    found = entities.build_relationships(tables.traces(spark, d), 2_592_000)
    return found.withColumn("child_span", F.col("child_span").cast("long"))


@query("WITH h AS (SELECT entity_id, metric_name, CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS idx, sum(value) AS v FROM metrics GROUP BY 1, 2, 3), p AS (SELECT a.entity_id, a.metric_name AS cause, b.metric_name AS effect, b.idx - a.idx AS lag, a.v AS x, b.v AS y FROM h a JOIN h b ON a.entity_id = b.entity_id AND b.idx - a.idx BETWEEN 1 AND 15 AND a.metric_name <> b.metric_name), c AS (SELECT entity_id, cause, effect, lag, corr(x, y) AS r, count(*) AS n FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) > 5), f AS (SELECT * FROM c WHERE NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY entity_id, cause, effect ORDER BY round(abs(r), 9) DESC, lag) = 1) SELECT entity_id, cause, effect, n, round(r, 6) AS r, lag FROM f WHERE abs(r) >= 0.5 AND atanh(least(abs(r), 1 - 1e-12)) * sqrt(n - 3) >= 1.959963984540054")
def lagged_correlation_edges(spark, d):
    day = (F.unix_micros(F.date_trunc("day", "ts")) / 86_400_000_000).cast("long")
    series = tables.metrics(spark, d).groupBy("entity_id", "metric_name", day.alias("idx")).agg(F.sum("value").alias("value"))
    return _micros(graph.lagged_correlation_edges(series, least_rows=6).drop("p")).withColumn("lag", F.col("lag").cast("long"))


FLAGSHIP = tumbling_features

from . import operations_queries  # noqa: E402, F401
