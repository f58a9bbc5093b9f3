"""Boundary cases of ingest, topology, policy, health, seasonal and entity operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, policy, resources, seasonal, topology
from tidemark.sources import ingest

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def test_security_events(spark):
    raw = spark.createDataFrame([('{"entityId":"e","attackType":"brute_force_attempt","confidence":"7","timestamp":"1715000000000","extra":"x"}',), ("{}",), ("no json",), (None,)], "value string")
    got = ingest.parse_security_events(raw).where("entity_id = 'e'").first()
    assert (got.attack_type, got.confidence, got.attributes, got.ts.year) == ("BRUTE_FORCE", 1.0, {"extra": "x"}, 2024)
    names = [r.attack_type for r in ingest.parse_security_events(raw).where("entity_id is null").collect()]
    assert set(names) <= {"UNKNOWN_ATTACK"}


def test_histograms(spark):
    rows = spark.createDataFrame([("e", "h", T0, 5000.0, [10.0, 50.0, 100.0, 500.0], [30, 40, 20, 8, 2])], "entity_id string, metric_name string, ts timestamp, sum double, bounds array<double>, counts array<long>")
    got = ingest.explode_histograms(rows).orderBy(F.col("le").asc_nulls_first()).collect()
    assert [(r.metric_name, r.value) for r in got] == [("h_sum", 5000.0)] + [("h_bucket", float(v)) for v in (30, 40, 20, 8)]


def test_split_batches(spark):
    schema = "type string, entity_id string, metrics array<struct<name:string,value:double,timestamp:string>>, logs array<struct<level:string,message:string,timestamp:string>>, traces array<struct<trace_id:string,span_id:string,parent_span_id:string,duration_ms:double,timestamp:string>>"
    rows = spark.createDataFrame([("siem", "a", None, [(None, "m", "bad")], None), ("metrics", "b", [("c", 1.0, "2024-01-01 00:00:00")], None, None), ("state", "c", None, None, None)], schema)
    got = ingest.split_batches(rows, F.lit(T0))
    assert sorted((r.entity_id, r.log_level, r.ts) for r in got["logs"].collect()) == [("a", "ERROR", T0), ("c", "INFO", T0)]
    assert [r.metric_name for r in got["metrics"].collect()] == ["c"] and got["traces"].count() == 0


def test_read_features(spark):
    rows = spark.createDataFrame([("a", at(k), at(k + 300), "5m") for k in (600, 0, 300)], "entity_id string, window_start timestamp, window_end timestamp, window_size string")
    assert [r.window_start for r in ingest.read_features(rows, "a", "5m", at(0), at(600)).collect()] == [at(0), at(300)]
    assert ingest.read_features(rows, "a").count() == 0


def test_nodes_and_edges(spark):
    rows = spark.createDataFrame([("a", "SERVICE", at(0), "x", ["b", "z"], None, None), ("a", "SERVICE", at(1), None, None, None, None), ("b", "DATABASE", at(0), "y", None, ["a"], None), ("c", "ODD", at(0), "w", None, None, None)], "id string, entity_type string, ts timestamp, name string, depends_on array<string>, calls array<string>, reads_from array<string>")
    nodes = topology.upsert_nodes(rows, ("name",))
    assert sorted((r.id, r.label, r.name) for r in nodes.collect()) == [("a", "Service", "x"), ("b", "Database", "y")]
    assert sorted((r.src, r.dst, r.type) for r in topology.build_edges(rows, nodes).collect()) == [("a", "b", "DEPENDS_ON"), ("b", "a", "CALLS")]


def test_root_causes(spark):
    signals = spark.createDataFrame([("d", at(1), "m", 0.9), ("d", at(0), "n", 0.8), ("x", at(0), "m", 0.7)], "symptom string, ts timestamp, metric_name string, score double")
    ranked = spark.createDataFrame([("d", "a", 0.6, 1)], "symptom string, root string, confidence double, rank int")
    got = {r.symptom: r for r in topology.build_root_causes(signals, ranked).collect()}
    assert (got["d"].root_cause_entity, [e.metric_name for e in got["d"].evidence]) == ("a", ["n", "m"])
    assert (got["x"].root_cause_entity, got["x"].confidence) == ("x", 0.0)


def test_alignment_and_ranking(spark):
    rows = [("e", m, i, float(f(i))) for m, f in (("a", lambda i: i * i), ("b", lambda i: (i - 2) ** 2), ("k", lambda i: 1)) for i in range(8)]
    series = spark.createDataFrame(rows, "entity_id string, metric_name string, idx long, value double")
    edges = spark.createDataFrame([("e", "a", "b", 2)], "entity_id string, cause string, effect string, lag int")
    assert all(r.x == r.y for r in topology.align_by_lag(series, edges).collect())
    got = topology.correlation_ranking(series, spark.createDataFrame([("e", "b")], "entity_id string, metric_name string")).collect()
    assert [r.metric_name for r in got] == ["a"]


def test_policy(spark):
    rows = spark.createDataFrame([(1, "P1", 96.0, "DATABASE"), (2, "P3", 50.0, "DATABASE"), (3, "P1", 99.0, "ODD")], "incident_id int, severity string, confidence double, entity_type string")
    actions = spark.createDataFrame([("DATABASE", "block_ip", True, 1), ("DATABASE", "restart", True, 2)], "entity_type string, action_type string, safe boolean, position int")
    routed = policy.route_actions(rows, policy.policy_decisions(rows, actions))
    assert {r.incident_id: (r.action_type, r.route) for r in routed.collect()} == {1: ("restart", "auto"), 2: ("block_ip", "approval"), 3: (None, "deny")}
    assert [r.incident_id for r in policy.pending_approvals(routed).collect()] == [2]


def test_grounding(spark):
    names = spark.createDataFrame([(1, "api-gateway"), (1, "ghost"), (2, "db_main")], "incident_id int, name string")
    known = spark.createDataFrame([(1, "apigateway-7"), (2, "db-main")], "incident_id int, entity string")
    got = {r.incident_id: (r.hallucinated, r.valid) for r in policy.grounding_check(names, known).collect()}
    assert got == {1: (["ghost"], False), 2: ([], True)}


def test_health(spark):
    rows = spark.createDataFrame([("c", at(0), 1.0, 10.0, 2, 5.0, 0.0), ("c", at(1), 2.0, 20.0, 2, 5.0, 10.0)], "container string, ts timestamp, cpu double, system double, ncpu int, used double, memory_limit double")
    assert [(r.cpu_percent, r.memory_percent) for r in health.cpu_percent(rows).orderBy("ts").collect()] == [(0.0, 0.0), (20.0, 50.0)]
    series = spark.createDataFrame([(k, "e", "m", v, at(60 * k)) for k, v in enumerate([0.0, 1.0, 1.0, 1.0, 0.0, 1.0])], "event_id int, entity_id string, metric_name string, value double, ts timestamp")
    assert [(r.started, r.points) for r in health.threshold_alerts(series, F.col("value") == 1, 120).collect()] == [(at(60), 3)]
    assert health.absence_alerts(series, 60).count() == 0 and health.absence_alerts(series, 59).count() == 5
    assert [r.increase for r in health.counter_increase(series).orderBy("ts").collect()] == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    buckets = spark.createDataFrame([("e", 1.0, 50), ("e", 2.0, 100)], "entity_id string, le double, count long")
    assert health.histogram_quantile(buckets, 0.75).first().quantile == 1.5


def test_seasons(spark):
    rows = [("e", "m", 100 + 20 * math.sin(2 * math.pi * k / 12), at(300 * k)) for k in range(60)]
    grid = seasonal.seasonal_grid(spark.createDataFrame(rows, "entity_id string, metric_name string, value double, ts timestamp"))
    periods = seasonal.seasonal_periods(grid)
    assert periods.first().period == 12
    got = seasonal.seasonal_predict(grid, seasonal.seasonal_fit(grid, periods)).collect()
    assert len(got) == 60 and all(abs(r.value - r.expected) < 1e-6 for r in got)
    flat = seasonal.seasonal_fit(grid, periods.where("false"))
    assert flat.count() == 1 and flat.first().period == 1


def test_composite_and_adjusted(spark):
    scores = spark.createDataFrame([("e", T0, "login_rate", 0.9, None), ("e", T0, "m", 0.2, 0.3), ("f", T0, "m", 0.1, 0.1)], "entity_id string, ts timestamp, metric_name string, a double, b double")
    got = seasonal.composite_anomaly(scores, ("a", "b")).collect()
    assert [(r.entity_id, r.metric_name, r.source_type, r.confidence) for r in got] == [("e", "login_rate", "security", 90.0)]
    assert seasonal.fuse_scores(scores, {"a": 1, "b": 1}).where("metric_name = 'login_rate'").first().fused == pytest.approx(0.45)
    points = spark.createDataFrame([("e", at(0), 1), ("e", at(300), 2), ("e", at(901), 3)], "entity_id string, ts timestamp, v int")
    events = spark.createDataFrame([("e", at(0)), ("e", at(600))], "entity_id string, ts timestamp")
    assert {r.v: r.factor for r in seasonal.adjusted_baselines(points, events).collect()} == {1: 1.5, 2: 1.5, 3: 1.0}


def test_resource_ids(spark):
    rules = [("aws", r"^arn:aws:rds:([a-z0-9-]+):\d+:db:(.+)$", 1, "DATABASE", 2), ("gcp", r"^projects/[^/]+/zones/([^/]+)/instances/(.+)$", 1, "WORKER_NODE", 2)]
    rows = spark.createDataFrame([("arn:aws:rds:eu-west-1:12:db:main",), ("projects/p/zones/us-central1-a/instances/vm",), ("odd",), (None,)], "raw string")
    got = [tuple(r.id) for r in rows.select(resources.parse_resource_id(F.col("raw"), rules, {"us-central1-a": "us-central1"}).alias("id")).collect()]
    assert got == [("aws", "eu-west-1", "DATABASE", "main", True), ("gcp", "us-central1", "WORKER_NODE", "vm", True), ("unknown", "", None, "odd", False), ("unknown", "", None, "", False)]
    tags = resources.business_tags(F.col("type"), F.col("name"), {"team": "ops"}, {"DATABASE": {"tier": "1"}}, [("DATABASE", "pay", {"team": "pay"}), (None, ".", {"x": "y"})])
    kinds = spark.createDataFrame([("DATABASE", "payments"), ("DATABASE", "z"), ("S", None)], "type string, name string")
    assert [r.t for r in kinds.select(tags.alias("t")).collect()] == [{"team": "pay", "tier": "1"}, {"team": "ops", "tier": "1", "x": "y"}, {"team": "ops"}]


def test_entity_windows(spark):
    rows = spark.createDataFrame([("e", f"r{k}", at(s)) for k, s in enumerate((0, 100, 299, 300, 650))], "entity_id string, raw_id string, ts timestamp")
    got = sorted((r.first_seen, r.last_seen, r.sightings, sorted(r.raw_ids)) for r in resources.dedup_entities(rows).collect())
    assert got == [(at(0), at(299), 3, ["r0", "r1", "r2"]), (at(300), at(300), 1, ["r3"]), (at(650), at(650), 1, ["r4"])]
