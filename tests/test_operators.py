"""Boundary cases of single operators."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import normalize as N
from tidemark.operators import features, graph, incidents, serving

T0 = dt.datetime(2024, 1, 1)


def test_percentiles_interpolate(spark):
    rows = spark.createDataFrame([(str(i), "e", "m", float(i), T0, False) for i in range(1, 101)], "event_id string, entity_id string, metric_name string, value double, ts timestamp, is_error boolean")
    got = features.sliding_features(rows, "5 minutes", "5 minutes").first()
    assert (got.p50, round(got.p95, 6), round(got.p99, 6)) == (50.5, 95.05, 99.01)


def test_burst_needs_more_than_threshold(spark):
    rows = [("e", "error", 1.0, T0 + dt.timedelta(seconds=k), True) for k in range(3)] + [("f", "error", 1.0, T0 + dt.timedelta(seconds=k), True) for k in range(4)]
    got = features.session_bursts(spark.createDataFrame(rows, "entity_id string, metric_name string, value double, ts timestamp, is_error boolean"))
    assert {r.entity_id: r.burst for r in got.collect()} == {"e": False, "f": True}


def test_fault_paths(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("c", "d", 2)], "src string, dst string, layer int")
    got = graph.fault_paths(edges, spark.createDataFrame([("d",), ("x",)], "symptom string")).collect()
    assert {r.symptom: r.path for r in got} == {"d": ["a", "b", "c", "d"], "x": ["x"]}
    edges = spark.createDataFrame([("gateway", "order", 1), ("order", "db", 1)], "src string, dst string, layer int")
    assert graph.fault_paths(edges, spark.createDataFrame([("gateway",)], "symptom string")).first().root == "db"


def test_dedup_renews(spark):
    at = [0, 300, 600, 901]
    rows = spark.createDataFrame([(k, "e", float(k), T0 + dt.timedelta(seconds=s)) for k, s in enumerate(at)], "incident_id int, root_cause_entity string, impact double, created_at timestamp")
    got = sorted((r.incident_id, r.deduplicated_count) for r in incidents.dedup_incidents(rows).collect())
    assert got == [(0, 3), (3, 1)]


def test_normalisers(spark):
    got = spark.range(1).select(
        N.hex_id(F.lit("AB-12"), 6).alias("i"), N.log_severity(F.lit("critical")).alias("s"), N.confidence(F.lit(0.5)).alias("c"),
        N.confidence(F.lit(1.5)).alias("d"), N.metric_value(F.lit(5.0), F.lit("ms")).alias("v"), N.span_status(F.lit("2")).alias("t"),
    ).first()
    assert tuple(got) == ("00ab12", "FATAL", 50.0, 100.0, 0.005, "ERROR")


def test_hours():
    assert [serving.resolve_hours(x) for x in ("24", "7d", "bad", 0, 9999, None)] == [24, 168, 24, 24, 720, None]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import jobs

    schema = "event_id long, entity_id string, metric_name string, value double, ts timestamp, is_error boolean"
    rows = [(k, "e", "m", float(k), T0 + dt.timedelta(seconds=70 * k), k % 3 == 0) for k in range(60)]
    batch = spark.createDataFrame(rows, schema)
    sentinel = spark.createDataFrame([(99, "e", "m", 0.0, T0 + dt.timedelta(days=1), False)], schema)
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    sentinel.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.feature_job(jobs.read_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), features.tumbling_features(batch)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_otlp(spark):
    from tidemark.sources import otlp

    res = '"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"web"}}]}'
    metric = f'{{"resourceMetrics":[{{{res},"scopeMetrics":[{{"metrics":[{{"name":"m","unit":"1","gauge":{{"dataPoints":[{{"timeUnixNano":"1715000000000000000","asDouble":42.5}},{{"timeUnixNano":"1715000001000000000","asInt":"7"}}]}}}}]}}]}}]}}'
    log = f'{{"resourceLogs":[{{{res},"scopeLogs":[{{"logRecords":[{{"observedTimeUnixNano":"1715000000000000000","severityNumber":9,"body":{{"stringValue":"hi"}}}}]}}]}}]}}'
    span = f'{{"resourceSpans":[{{{res},"scopeSpans":[{{"spans":[{{"traceId":"t","spanId":"s","name":"op","startTimeUnixNano":"1715000000000000000","endTimeUnixNano":"1715000000000500000","status":{{"code":1}},"attributes":[{{"key":"http.method","value":{{"stringValue":"GET"}}}}]}}]}}]}}]}}'
    raw = spark.createDataFrame([(metric,), (log,), (span,), ("{}",)], "value string")
    assert [(r.entity_id, r.value, r.ts.timestamp() > 0) for r in otlp.parse_otlp_metrics(raw).orderBy("ts").collect()] == [("web", 42.5, True), ("web", 7.0, True)]
    assert [(r.log_level, r.message) for r in otlp.parse_otlp_logs(raw).collect()] == [("INFO", "hi")]
    assert [(r.duration_ms, r.status, r.attributes) for r in otlp.parse_otlp_traces(raw).collect()] == [(0, "OK", {"span.http.method": "GET"})]
    assert [r.signal for r in otlp.route_signal_type(raw).collect()] == ["metrics", "logs", "traces", "events"]


def test_sinks(spark, tmp_path):
    from tidemark.sources import sinks

    rows = spark.createDataFrame([("a", 1, T0), ("b", 2, T0 + dt.timedelta(days=1))], "entity_id string, v int, ts timestamp")
    sinks.write_table(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    new = sinks.upsert_latest(rows, spark.createDataFrame([("a", 9, T0)], rows.schema), "entity_id", "ts")
    assert sorted((r.entity_id, r.v) for r in new.collect()) == [("a", 9), ("b", 2)]
    assert sinks.apply_retention(rows, "ts", 1, T0 + dt.timedelta(days=2)).count() == 1


def test_exfil_mean_of_earlier_rows_alone(spark, tmp_path):
    """Rows of one time, at the limit, infinite or without entity or time: as the query's SQL has them."""
    hour, inf = 3_600_000_000, float("inf")
    # user, microseconds, value; ids in this order. At the limit: 36.2 is three times the mean of six zeros and three of it.
    rows = [(1, 0, 0.0)] * 6 + [(1, hour, 36.2)] * 5 + [(2, 0, 13.38)] * 6 + [(2, hour, 120.42)] * 4
    rows += [(3, 0, 1.0), (3, 1, inf), (3, 24 * hour, 4.0), (3, 48 * hour, 9.0), (4, 0, 1.0), (4, 24 * hour, 4.0), (4, 48 * hour + 1, 9.0)]
    rows += [(5, 0, 1.0), (5, 0, 7.0), (5, 0, None), (5, 1, 13.0), (6, 0, 5.0), (6, 1, float("nan")), (6, 1, 50.0)]
    rows += [(None, 0, 1.0), (None, 1, 9.0), (7, None, 1.0), (7, None, 9.0), (8, 0, -1.0), (8, 1, 9.0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE r (event_id BIGINT, user_id BIGINT, us BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", [(k, *row) for k, row in enumerate(rows)])
    con.execute(f"COPY (SELECT event_id, make_timestamp(us) AS ts, user_id, 'view' AS event_type, value FROM r) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = sorted(tuple(r) for r in queries.QUERIES["detect_data_exfil"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(queries.SQL["detect_data_exfil"]).fetchall())
    # 9 and 19 are at the limit, 22 is infinite.
    assert {9, 19, 22} & {k for k, _ in got} == {22}
