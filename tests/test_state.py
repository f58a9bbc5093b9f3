"""Keyed state over three micro-batches and more, against the batch operators over the union."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, features, health, incidents, resources
from tidemark.streaming import state

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def batches(spark, tmp_path, schema, parts):
    """A stream that gives one of ``parts`` in each micro-batch, in this order."""
    path = tmp_path / "in"
    path.mkdir()
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        source = next((tmp_path / f"part{k}").glob("*.parquet"))
        os.rename(source, path / f"{k}.parquet")
        os.utime(path / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, df, tmp_path, name="out"):
    """All batches of ``df`` to a folder, and what is there."""
    with state.rocksdb(spark):
        query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / name)), query


def test_entity_windows(spark, tmp_path):
    r = random.Random(5)
    schema = "entity_id string, raw_id string, ts timestamp"
    rows = sorted(((r.choice("abc"), r.choice(["x", "y", None]), at(r.randrange(4000))) for _ in range(300)), key=lambda x: x[2])
    rows += rows[:1] * 0
    # Within the lateness rows come in any order; two equal rows; the last row lets the watermark pass the others.
    parts = [rows[:120], rows[120:121] + rows[121:200], [*rows[200:], rows[-1]], [("end", "z", at(9000))]]
    for part in parts:
        r.shuffle(part)
    parts[1].append(("a", "w", at(int((rows[119][2] - T0).total_seconds()) - 30)))
    got, _ = run(spark, state.entity_windows(batches(spark, tmp_path, schema, parts), lateness="60 seconds"), tmp_path)
    want = resources.dedup_entities(spark.createDataFrame([x for part in parts for x in part], schema)).where("entity_id != 'end'")
    key = lambda df: sorted((x.entity_id, x.first_seen, x.last_seen, x.sightings, x.raw_ids) for x in df.collect())
    assert key(got) == key(want) and got.count() > 20
    assert got.where("first_seen != last_seen").count() > 0


def test_sessions_and_noise(spark, tmp_path):
    r = random.Random(6)
    schema = "event_id long, entity_id string, metric_name string, ts timestamp, score double, anomalous boolean, source_type string, affected_neighbors int"
    rows = []
    for k in range(240):
        score = r.choice([0.2, 0.3, 0.6, 0.9])
        rows.append((k, r.choice("ab"), "m", at(5 * k), score, score > 0.5, r.choice(["performance", "performance", "security"]), r.choice([0, 0, 0, 3])))
    parts = [rows[:70], rows[70:150], rows[150:], [(999, "end", "m", at(9000), 0.1, False, "performance", 0)]]
    found, _ = run(spark, state.sessions_and_noise(batches(spark, tmp_path, schema, parts)), tmp_path)
    union = spark.createDataFrame(rows, schema)
    want = {x.event_id: x.keep for x in detect.suppress_noise(union.where("anomalous")).collect()}
    got = {x.event_id: x.keep for x in found.where("kind = 'signal'").collect()}
    assert got == want and set(want.values()) == {True, False}
    # A batch alone would call the start of each batch new.
    alone = {x.event_id: x.keep for x in detect.suppress_noise(spark.createDataFrame(parts[1], schema).where("anomalous")).collect()}
    assert any(alone[k] != want[k] for k in alone)
    key = lambda df: sorted((x.entity_id, x.started, x.ended, x.peak, x.points, x.resolved, x.duration_s) for x in df.collect() if x.entity_id != "end")
    assert key(state.latest_sessions(found)) == key(detect.anomaly_sessions(union))
    assert {x.resolved for x in state.latest_sessions(found).collect()} == {True, False}


def test_open_incidents(spark, tmp_path):
    schema = "incident_id string, root_cause_entity string, created_at timestamp, impact double"
    db = [(f"i{k}", "db", at(200 * k), 10.0 + k % 4) for k in range(10)]
    rest = [("late", "db", at(9 * 200 + 301), 5.0), ("none", None, at(100), 1.0), ("empty", "", at(100), 2.0), ("c1", "cache", at(0), 3.0), ("c2", "cache", at(300), 1.0), ("c3", "cache", at(601), 1.0)]
    rows = sorted(db + rest, key=lambda x: x[2])
    parts = [rows[:5], rows[5:9], rows[9:], [("end", "end", at(99999), 0.0)]]
    found, _ = run(spark, state.open_incidents(batches(spark, tmp_path, schema, parts)), tmp_path)
    store = {x.incident_id: x for x in state.incident_store(found).collect()}
    assert store["i0"].deduplicated_count == 10 and store["i0"].related_incidents == [f"i{k}" for k in range(10)] and store["i0"].impact == 13.0
    assert store["late"].deduplicated_count == 1 and {x.status for k, x in store.items() if k != "end"} == {"closed"}
    assert found.where("incident_id = 'i0' AND status = 'open'").count() >= 1 and store['i0'].status == 'closed'
    assert found.where("incident_id = 'i0' AND status = 'opened'").count() == 1
    union = spark.createDataFrame(rows, schema).withColumn("root_cause_entity", F.coalesce(F.when(F.col("root_cause_entity") != "", F.col("root_cause_entity")), F.col("incident_id")))
    key = lambda df: sorted((x.incident_id, x.created_at, x.deduplicated_count, x.impact, x.related_incidents) for x in df.collect() if x.incident_id != "end")
    assert key(state.incident_store(found)) == key(incidents.dedup_incidents(union))


def test_absences(spark, tmp_path):
    schema = "event_id long, entity_id string, metric_name string, value double, ts timestamp"
    rows = [(k, "beat", "up", 1.0, at(60 * k)) for k in range(60)]
    rows += [(100, "gone", "up", 1.0, at(0)), (101, "gone", "up", 1.0, at(100)), (102, "back", "up", 1.0, at(30)), (103, "back", "up", 1.0, at(2000)), (104, "back", "up", 1.0, at(2300)), (105, "edge", "up", 1.0, at(0)), (106, "edge", "up", 1.0, at(600))]
    rows = sorted(rows, key=lambda x: x[4])
    parts = [rows[:15], rows[15:40], rows[40:], [(999, "end", "up", 1.0, at(3700))]]
    found, _ = run(spark, state.absences(batches(spark, tmp_path, schema, parts), 600, "0 seconds"), tmp_path)
    got = sorted((x.entity_id, x.since, x.until) for x in found.where("until IS NOT NULL").collect())
    want = health.absence_alerts(spark.createDataFrame(rows, schema), 600, now=at(3700))
    assert got == sorted((x.entity_id, x.since, x.until) for x in want.where("until IS NOT NULL").collect()) == [("back", at(30), at(2000))]
    # A gap that ended may have been told while it lasted.
    silent = {(x.entity_id, x.since) for x in found.where("until IS NULL").collect()}
    assert silent - {("back", at(30))} == {(x.entity_id, x.since) for x in want.where("until IS NULL").collect()} == {("gone", at(100)), ("back", at(2300)), ("edge", at(600))}

@pytest.mark.parametrize("percentiles", [True, False])
def test_vectors(spark, tmp_path, percentiles):
    r = random.Random(7)
    schema = "entity_id string, metric_name string, window_start timestamp, window_end timestamp, window_size string, min double, max double, avg double, count long, error_rate double"
    rows = []
    for k in range(90):
        size = r.choice([60, 300])
        end = 300 + 60 * (k // 3)
        rows.append((r.choice("ab"), f"m{k % 3}", at(end - size), at(end), f"{size // 60} minutes", r.random(), 1 + r.random(), 1.0, r.choice([1, 2, 5]), r.choice([None, 0.5])))
    parts = [rows[:30], rows[30:31], rows[31:60], rows[60:], [("end", "m", at(90000), at(90060), "1 minutes", 0.0, 0.0, 0.0, 1, None)]]
    stream, union = batches(spark, tmp_path, schema, parts), spark.createDataFrame(rows, schema)
    if percentiles:
        stream, union = (x.withColumns({"p50": F.col("max") / 2, "p95": F.when(F.col("max") > 1.5, F.col("max")), "p99": F.col("max")}) for x in (stream, union))
    got, query = run(spark, state.vectors(stream), tmp_path)
    want = features.feature_vectors(union)
    columns = sorted(want.columns)
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (x[c] for c in columns)) for x in df.where("entity_id != 'end'").collect())
    key = lambda rows: sorted(rows, key=str)
    assert key(map(str, rounded_safe(got, columns))) == key(map(str, rounded_safe(want, columns)))
    # A batch reads its own rows only.
    assert [x["numInputRows"] for x in query.recentProgress if x["numInputRows"]] == [len(x) for x in parts]


def rounded_safe(df, columns):
    return [tuple(round(x[c], 9) if isinstance(x[c], float) else x[c] for c in columns) for x in df.where("entity_id != 'end'").collect()]
