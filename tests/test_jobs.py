"""Streaming jobs, plans and detectors that SQL cannot express."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, forest, health, policy, seasonal, serving, topology
from tidemark.plans.detection import score_points
from tidemark.plans.response import incident_pipeline, log_evidence
from tidemark.sources import sinks
from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def files(df, tmp_path, name):
    """``df`` as a stream."""
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def test_ingest_job(spark, tmp_path):
    lines = [
        '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a"}}]},"scopeMetrics":[{"metrics":[{"name":"m","unit":"ms","gauge":{"dataPoints":[{"timeUnixNano":"1700000000000000000","asLong":"1500"}]}}]}]}]}',
        '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"orders-db"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"1700000000000000000","severityText":"CRITICAL","body":{"stringValue":" x  y "},"attributes":[{"key":"k8s.pod.name","value":{"stringValue":"p"}}]}]}]}]}',
        '{"attackType":"brute_force_attempt","entity_id":"e","confidence":"2"}',
        '{"attackType":"none"}',
    ]
    out = str(tmp_path / "out")
    done(jobs.ingest_job(files(spark.createDataFrame([(x,) for x in lines], "value string"), tmp_path, "raw"), out, str(tmp_path / "c")))
    assert [(r.entity_id, r.value) for r in spark.read.parquet(out + "/metrics").collect()] == [("a", 1.5)]
    log = spark.read.parquet(out + "/logs").first()
    assert (log.entity_type, log.log_level, log.message, log.attributes["k8s.pod"]) == ("DATABASE_NODE", "FATAL", "x y", "p")
    assert [(r.attack_type, r.confidence) for r in spark.read.parquet(out + "/events").collect()] == [("BRUTE_FORCE", 1.0)]
    assert spark.read.text(out + "/archive").count() == 3


def test_feature_and_vector_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(k, "e", "m", float(k), at(20 * k), k % 2 == 0) for k in range(60)], "event_id int, entity_id string, metric_name string, value double, ts timestamp, is_error boolean")
    for query in jobs.feature_jobs(files(rows, tmp_path, "in"), str(tmp_path / "w"), str(tmp_path / "c")).values():
        done(query)
    closed = spark.read.parquet(str(tmp_path / "w/tumbling-1-minute"))
    assert {r["count"] for r in closed.collect()} == {3} and spark.read.parquet(str(tmp_path / "w/sliding")).count() > 0
    stream = spark.readStream.schema(closed.schema).parquet(str(tmp_path / "w/tumbling-1-minute"))
    done(jobs.vector_job(stream, str(tmp_path / "v"), str(tmp_path / "cv"), lateness="0 seconds"))
    last = spark.read.parquet(str(tmp_path / "v")).orderBy(F.desc("feature_version")).first()
    assert last.feature_version == closed.count() and last.request_volume == 3 * closed.count()


def test_entity_and_relationship_jobs(spark, tmp_path):
    seen = spark.createDataFrame([("k8s:pod:shop/frontend-1", at(0)), ("k8s:pod:shop/frontend-1", at(10)), ("odd", at(0)), ("later", at(900))], "raw_id string, ts timestamp")
    done(jobs.entity_job(files(seen, tmp_path, "seen"), str(tmp_path / "e"), str(tmp_path / "c")))
    got = {r.entity_id: (r.sightings, r.tags["criticality"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert got == {"k8s:API_NODE/frontend-1": (2, "MEDIUM"), "unknown:UNKNOWN_NODE/odd": (1, "LOW")}
    spans = spark.createDataFrame([("t", "1", "", "a", 1.0, at(0)), ("t", "2", "1", "b", 2.0, at(5)), ("t", "3", "1", "a", 2.0, at(5)), ("t", "4", "1", "c", 2.0, at(900))], "trace_id string, span_id string, parent_span_id string, service_name string, duration_ms double, ts timestamp")
    done(jobs.relationship_job(files(spans, tmp_path, "spans"), str(tmp_path / "r"), str(tmp_path / "cr")))
    assert [(r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [("a", "b")]


def test_detect_security_and_learning_jobs(spark, tmp_path):
    r = random.Random(1)
    schema = "event_id int, entity_id string, metric_name string, value double, ts timestamp"
    history = spark.createDataFrame([(k, "n1", "login_rate", r.gauss(10, 1), at(k)) for k in range(60)], schema)
    points = spark.createDataFrame([(100, "n1", "login_rate", 30.0, at(500)), (101, "n1", "login_rate", 10.0, at(501)), (102, "n1", "cold", 99.0, at(502))], schema)
    nodes = spark.createDataFrame([("n1", "name", "Service", "HIGH")], "id string, name string, label string, criticality string")
    points = points.union(spark.createDataFrame([(103, "n2", "login_rate", 10.0, at(900))], schema))
    done(jobs.detect_job(files(points, tmp_path, "p"), history, str(tmp_path / "scored"), str(tmp_path / "c"), spark.createDataFrame([("n1", "n2")], "src string, dst string")))
    scored = spark.read.parquet(str(tmp_path / "scored")).drop("batch")
    done(jobs.signal_job(spark.readStream.schema(scored.schema).parquet(str(tmp_path / "scored")), nodes, str(tmp_path / "d"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "d/sessions")).where("entity_id = 'n1'").first().points == 2
    assert [(x.event_id, x.source_type, x.node_name) for x in spark.read.parquet(str(tmp_path / "d/signals")).collect()] == [(100, "security", "name")]
    events = spark.createDataFrame([(k, "u", "login failed", "1.2.3.4", at(k)) for k in range(10)] + [(50, "u", "sudo x", "", at(3))], "event_id int, entity_id string, message string, source_ip string, ts timestamp")
    none = spark.createDataFrame([], "change_id string")
    done(jobs.security_job(spark, files(events, tmp_path, "ev"), none, str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "cs")))
    assert {(x.event_id, x.attack_type) for x in spark.read.parquet(str(tmp_path / "s")).collect()} == {(9, "BRUTE_FORCE"), (50, "PRIVILEGE_ESCALATION")}
    results = spark.createDataFrame([("1", 7, "e", "rollback", True)], "action_id string, incident_id int, entity_id string, action_type string, success boolean")
    causes = spark.createDataFrame([(k, "db", "P1", at(k)) for k in range(2)], "incident_id int, root_cause_entity string, severity string, created_at timestamp")
    done(jobs.learning_job(files(results, tmp_path, "res"), str(tmp_path / "l"), str(tmp_path / "cl"), causes))
    assert spark.read.parquet(str(tmp_path / "l/knowledge")).first().outcome == "success" and spark.read.parquet(str(tmp_path / "l/patterns")).count() == 1


def test_forest_and_threshold_in_the_chain(spark):
    r = random.Random(1)
    schema = "event_id int, entity_id string, metric_name string, value double, ts timestamp, a double, b double"
    history = spark.createDataFrame([(k, "n1", "share", r.gauss(0.2, 0.01), at(k), r.gauss(0, 1), r.gauss(0, 1)) for k in range(300)] + [(1000 + k, "n1", "load", r.gauss(50, 1), at(k), 0.0, 0.0) for k in range(60)], schema)
    points = spark.createDataFrame([(1, "n1", "share", 0.9, at(500), 30.0, -30.0), (2, "n1", "share", 0.9, at(501), 0.0, 0.0), (3, "n1", "load", 90.0, at(502), 0.0, 0.0), (4, "new", "load", 90.0, at(503), 0.0, 0.0)], schema)
    trees = (("a", "b"), forest.fit_forest(history, ("a", "b"), "event_id"))
    plain = {x.event_id: x for x in score_points(points, history).collect()}
    assert all(x.anomalous for x in plain.values())
    full = {x.event_id: x for x in score_points(points, history, trees=trees, deviations=3.0).collect()}
    # The forest tells the first two apart; a score of 1 at most is below the threshold of a series around 50, and a new series has none.
    assert full[1].fused > full[2].fused and plain[1].fused == plain[2].fused
    assert {k: x.anomalous for k, x in full.items()} == {1: True, 2: True, 3: False, 4: True}
    assert score_points(points, history, trees=(("a", "b"), None)).count() == 4


def test_incident_job(spark, tmp_path):
    nodes = spark.createDataFrame([("api", "API_NODE"), ("db", "DATABASE_NODE")], "id string, entity_type string")
    edges = spark.createDataFrame([("api", "db", 1), ("db", "api", 2)], "src string, dst string, layer int")
    signals = spark.createDataFrame([("api", "gcp", "eu", "API_NODE", "m", 0.9, at(0)), ("api", "gcp", "eu", "API_NODE", "m", 0.8, at(9))], "entity_id string, provider string, region string, entity_type string, metric_name string, score double, ts timestamp")
    found, routed = incident_pipeline(signals, nodes, edges, policy.action_registry(spark))
    row = found.first()
    assert (row.root_cause_entity, row.entity_type, row.severity, row.deduplicated_count) == ("db", "DATABASE_NODE", "P2", 1)
    assert row.confidence == pytest.approx(85 * (0.6 + 0.4 * 0.88), abs=0.1) and routed.first().route == "approval"
    logs = spark.createDataFrame([("db", at(-k), f"line {k}") for k in range(8)] + [("db", at(-400), "old"), ("db", at(1), "later"), ("api", at(0), "other"), ("db", at(0), None)], "entity_id string, ts timestamp, message string")
    more = incident_pipeline(signals, nodes, edges, policy.action_registry(spark), logs=logs)[0].first()
    assert more.impact == row.impact + 5
    snippets = log_evidence(found.select("incident_id", "root_cause_entity", "created_at"), logs).first().log_snippets
    assert snippets == [f"line {k}" for k in (4, 3, 2, 1, 0)]
    later = spark.createDataFrame([("zz", "gcp", "eu", "API_NODE", "m", 0.9, at(900))], signals.schema)
    done(jobs.incident_job(files(signals.union(later), tmp_path, "s"), nodes, edges, str(tmp_path / "built"), str(tmp_path / "c"), logs))
    built = spark.read.parquet(str(tmp_path / "built")).drop("batch")
    done(jobs.response_job(spark.readStream.schema(built.schema).parquet(str(tmp_path / "built")), policy.action_registry(spark), str(tmp_path / "o"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "o/approvals")).count() == 1
    kept = spark.read.parquet(str(tmp_path / "o/incidents"))
    assert {(x.root_cause_entity, x.status) for x in kept.collect()} == {("db", "opened"), ("db", "closed")}


def test_topic(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    done(sinks.write_stream_topic(files(rows, tmp_path, "in"), str(tmp_path / "topic"), str(tmp_path / "c")))
    assert [r.value for r in spark.read.text(str(tmp_path / "topic")).collect()] == ['{"x":1,"y":"a"}']
    done(sinks.write_stream_topic(files(rows, tmp_path, "in2"), str(tmp_path / "log"), str(tmp_path / "c2"), key="x", writer="q"))
    seen = []
    query = jobs.read_stream(spark, str(tmp_path / "log"), "", log=True).writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    done(query)
    assert [(r.key, r.value) for r in seen] == [("1", '{"x":1,"y":"a"}')]


def test_security_history_is_pruned(spark, tmp_path):
    """Ten failures over three batches are one attack; a batch that lies too far back is not read."""
    schema = "event_id int, entity_id string, message string, source_ip string, ts timestamp"
    source = tmp_path / "in"
    source.mkdir()
    events = [(k, "u", "login failed", "1.2.3.4", at(4000 + 10 * k)) for k in range(10)]
    for k, rows in enumerate(([(90, "u", "login failed", "1.2.3.4", at(0))], events[:4], events[4:8], events[8:])):
        path = str(tmp_path / f"p{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(source / f"{k}.parquet")
    for k in range(4):
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    done(jobs.security_job(spark, stream, spark.createDataFrame([], "change_id string"), str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "c")))
    assert [(x.event_id, x.attack_type, x.batch) for x in spark.read.parquet(str(tmp_path / "s")).collect()] == [(9, "BRUTE_FORCE", 3)]


def test_forest(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(k, r.gauss(0, 1), r.gauss(5, 2)) for k in range(400)] + [(999, 12.0, -30.0)], "event_id int, a double, b double")
    fitted = forest.fit_forest(rows, ("a", "b"), "event_id")
    scores = {x.event_id: x.forest_score for x in forest.forest_score(rows, ("a", "b"), fitted).collect()}
    assert max(scores, key=scores.get) == 999 and scores[999] > 0.5
    # The offset leaves five in a hundred of the sample on the odd side.
    assert 0.03 < sum(s > 0.5 for s in scores.values()) / len(scores) < 0.08
    assert forest.fit_forest(rows.limit(50), ("a", "b"), "event_id") is None
    odd = spark.createDataFrame([(1, None, float("nan"))], "event_id int, a double, b double")
    assert 0 <= forest.forest_score(odd, ("a", "b"), fitted).first().forest_score <= 1


def test_adwin_and_refit(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, "e", "m", r.random() * 0.1 + (0.8 if k >= 300 else 0.0), at(k)) for k in range(600)], "event_id int, entity_id string, metric_name string, value double, ts timestamp")
    got = detect.adwin_drift(rows)
    fired = [x.event_id for x in got.where("drift").collect()]
    assert fired and 300 <= min(fired) < 320
    assert got.agg(F.max("window_size")).first()[0] <= 600 and got.count() == 600
    fresh = detect.retrain_on_drift(rows, got, detect.zscore_baselines(rows), last=100).first()
    assert fresh.refitted and fresh["mean"] == pytest.approx(0.85, abs=0.02)


def test_rules_noise_and_nan(spark):
    schema = "event_id int, entity_id string, metric_name string, value double, ts timestamp"
    rows = spark.createDataFrame([(1, "e", "latency_p99", 9.0, at(0)), (2, "e", "error_rate", 0.06, at(0)), (3, "e", "request_volume", 4.0, at(0)), (4, "e", "error_rate", 0.05, at(0))], schema)
    base = spark.createDataFrame([("latency_p99", 3.0, 2.0), ("request_volume", 10.0, 1.0)], "metric_name string, mean double, std double")
    assert {x.event_id for x in detect.metric_rules(rows, base).collect()} == {1, 2, 3}
    odd = spark.createDataFrame([(1, "e", "m", float("nan"), at(0)), (2, "e", "m", float("inf"), at(0)), (3, "e", "m", None, at(0))], schema)
    flat = spark.createDataFrame([("m", 0.0, 1.0)], "metric_name string, mean double, std double")
    assert {x.score for x in detect.zscore_score(odd, flat).collect()} == {0.0}
    signals = spark.createDataFrame([(1, "e", "m", at(0), 0.1, "performance", 0), (2, "e", "m", at(1), 0.1, "security", 0), (3, "e", "m", at(2), 0.1, None, 3), (4, "e", "m", at(3), 0.9, None, None)], "event_id int, entity_id string, metric_name string, ts timestamp, score double, source_type string, affected_neighbors int")
    assert {x.event_id for x in detect.suppress_noise(signals).where("keep").collect()} == {2, 3, 4}
    around = detect.affected_neighbors(spark.createDataFrame([("a",), ("b",)], "entity_id string"), spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string"))
    assert {x.entity_id: x.affected_neighbors for x in around.collect()} == {"a": 1, "b": 1}


def test_fusion(spark):
    rows = spark.createDataFrame([(k / 10, 0.5, int(k > 5)) for k in range(11)], "a double, b double, label int")
    model = seasonal.fit_fusion(rows, ("a", "b"))
    fused = [x.fused for x in seasonal.fuse_fitted(rows, model, {"a": 1, "b": 1}).orderBy("a").collect()]
    assert fused == sorted(fused) and fused[-1] > 0.5 > fused[0]
    assert seasonal.fit_fusion(rows.where("label = 1"), ("a", "b")) is None
    assert seasonal.fuse_fitted(rows, None, {"a": 1, "b": 1}).first().fusion_confidence == 0


def test_safe_sql(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    rows, more = serving.safe_sql(spark, "SELECT id, 'DROP it' AS said FROM five", 3)
    assert rows.count() == 3 and more
    rows, more = serving.safe_sql(spark, "SELECT id FROM five", 5)
    assert rows.count() == 5 and not more
    path = str(tmp_path / "t")
    for text in ("INSERT INTO five VALUES (1)", "DROP VIEW five", "SET a=b", f"CREATE TABLE t USING parquet LOCATION '{path}' AS SELECT 1", "ADD JAR x", "CACHE TABLE five", "SELECT 1; DROP VIEW five", "REFRESH TABLE five", "EXPLAIN SELECT 1", "SHOW TABLES"):
        with pytest.raises(PermissionError):
            serving.safe_sql(spark, text)
    assert spark.table("five").count() == 5


ACTS = ["reflect('java.lang.System', 'setProperty', 'probe', 'set')", "java_method('java.lang.System', 'setProperty', 'probe', 'set')", "try_reflect('java.lang.System', 'setProperty', 'probe', 'set')", "input_file_name()", "system.builtin.reflect('java.lang.System', 'setProperty', 'probe', 'set')", "nothing_known(1)"]
SHAPES = ["SELECT {}", "SELECT id FROM five WHERE {} = 'a'", "SELECT (SELECT max({}) FROM five) AS x", "WITH a AS (SELECT {} AS x) SELECT * FROM a", "SELECT id FROM five WHERE EXISTS (SELECT {} FROM five)", "SELECT id FROM five WHERE id IN (SELECT {} FROM five)", "SELECT transform(array(1), x -> {}) FROM five", "SELECT id FROM five ORDER BY {}", "SELECT count(*) FROM five GROUP BY {}", "SELECT 1 UNION ALL SELECT {}", "SELECT max(id) OVER (PARTITION BY {}) FROM five", "SELECT * FROM five JOIN five AS b ON five.id = {}", "SELECT CASE WHEN true THEN {} END", "SELECT * FROM VALUES ({}) AS t(x)", "SELECT * FROM five LATERAL VIEW explode(array({})) AS e"]


def test_safe_sql_lets_nothing_act(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    (tmp_path / "secret.txt").write_text("secret")
    for act in ACTS:
        for shape in SHAPES:
            with pytest.raises(PermissionError):
                serving.safe_sql(spark, shape.format(act))
    assert spark._jvm.System.getProperty("probe") is None
    for text in (f"SELECT * FROM text.`{tmp_path}/secret.txt`", f"SELECT (SELECT count(*) FROM text.`{tmp_path}/secret.txt`)", f"WITH a AS (SELECT * FROM csv.`{tmp_path}`) SELECT * FROM a", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM five", "SELECT * FROM range(10)", "SELECT * FROM explode(array(1))", "SELECT * FROM spark_catalog.default.t"):
        with pytest.raises(PermissionError):
            serving.safe_sql(spark, text)
    good = ["SELECT max(id) AS m FROM five GROUP BY id % 2 HAVING max(id) > 1 ORDER BY m LIMIT 3", "WITH a AS (SELECT id FROM five) SELECT a.id, row_number() OVER (ORDER BY a.id) AS n FROM a JOIN five b ON a.id = b.id", "SELECT id FROM five WHERE id IN (SELECT max(id) FROM five)", "SELECT x FROM five LATERAL VIEW explode(sequence(1, 2)) e AS x", "SELECT upper(concat('a', id)) AS u, CASE WHEN id > 2 THEN 1 ELSE 0 END AS c FROM five UNION SELECT 'b', 1", "SELECT * FROM five LEFT ANTI JOIN VALUES (1), (2) AS t(id) USING (id)", "SELECT DISTINCT date_trunc('day', timestamp '2024-01-01') AS d, percentile(id, 0.5) AS p FROM five"]
    for text in good:
        got, _ = serving.safe_sql(spark, text)
        assert sorted(got.collect()) == sorted(spark.sql(text).collect())
    with pytest.raises(PermissionError):
        serving.safe_sql(spark, "SELECT * FROM five", tables=["other"])
    assert serving.safe_sql(spark, "WITH other AS (SELECT * FROM five) SELECT * FROM other", tables=["FIVE"])[0].count() == 5


def test_health_rules(spark):
    rows = [(k, "e", "c", float(min(k, 3)), at(60 * k)) for k in range(12)]
    series = spark.createDataFrame(rows, "event_id int, entity_id string, metric_name string, value double, ts timestamp")
    got = health.evaluate_alert_rules(series, [{"name": "stuck", "metric": "c", "kind": "rate_zero", "seconds": 60}, {"name": "grows", "metric": "c", "kind": "rate_above", "limit": 0.0, "seconds": 60}]).collect()
    assert {(x.rule, x.started, x.ended) for x in got} == {("stuck", at(540), at(660)), ("grows", at(60), at(480))}


def test_short_alignment(spark):
    series = spark.createDataFrame([("e", m, i, float(i)) for m in "ab" for i in range(4)], "entity_id string, metric_name string, idx long, value double")
    edges = spark.createDataFrame([("e", "a", "b", 2)], "entity_id string, cause string, effect string, lag int")
    assert {x.lag for x in topology.align_by_lag(series, edges).collect()} == {0} and topology.align_by_lag(series, edges).count() == 4
