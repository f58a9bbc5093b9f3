"""The topic source over restarts, versions of models, late rows."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.sources import models, topic
from tidemark.streaming import late

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def drain(df, tmp_path, name, **sink):
    query = df.writeStream.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    for k, v in sink.items():
        query = getattr(query, k)(v)
    query = query.start()
    query.awaitTermination()
    return query


def test_topic_over_restarts(spark, tmp_path):
    topic.register(spark)
    path, source = str(tmp_path / "topic"), tmp_path / "in"
    stream = lambda: spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).json(str(source))

    def produce(first, n):
        source.mkdir(exist_ok=True)
        for k in range(first, first + n):
            (source / f"{k}.json").write_text("\n".join(json.dumps({"key": f"k{k}", "value": f"v{k}.{i}"}) for i in range(10)))
        query = stream().writeStream.format("topic").option("path", path).option("writer", "a").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
        query.awaitTermination()

    seen, fail = [], []

    def take(batch, number):
        rows = [x.value for x in batch.collect()]
        if fail:
            fail.pop()
            raise ValueError("lost")
        seen.append((number, rows))

    read = lambda: spark.readStream.format("topic").option("path", path).load()
    produce(0, 3)
    drain(read(), tmp_path, "r", foreachBatch=take)
    produce(3, 2)
    fail.append(True)
    with pytest.raises(Exception, match="lost"):
        drain(read(), tmp_path, "r", foreachBatch=take)
    produce(5, 1)
    drain(read(), tmp_path, "r", foreachBatch=take)
    drain(read(), tmp_path, "r", foreachBatch=take)
    got = [x for _, rows in seen for x in rows]
    assert sorted(got) == sorted(f"v{k}.{i}" for k in range(6) for i in range(10))
    # Another writer, and a batch that is committed again.
    writer = topic.TopicWriter(path, "b", ["key", "value"])
    rows = spark.createDataFrame([("x", "one"), (None, None)], "key string, value string").collect()
    first = writer.write(iter(rows))
    writer.commit([first, None], 0)
    again = writer.write(iter(rows))
    writer.commit([again], 0)
    lost = writer.write(iter(rows))
    writer.abort([lost, None], 1)
    folder = topic._Folder(path)
    assert folder.there(first.names[0]) and not folder.there(again.names[0]) and not folder.there(lost.names[0])
    drain(read(), tmp_path, "r", foreachBatch=take)
    assert sorted(seen[-1][1], key=str) == [None, "one"]
    table = spark.read.format("topic").option("path", path).load()
    assert table.count() == 62 and table.where("key = 'k3'").count() == 10
    assert spark.read.format("topic").option("path", str(tmp_path / "nothing")).load().count() == 0


def test_models_are_versions(spark, tmp_path):
    r = random.Random(4)
    schema = "event_id int, entity_id string, metric_name string, value double, ts timestamp"
    rows = [(k, "e", m, r.gauss(10, 0.1), at(k)) for k in range(400) for m in ("a", "b")]
    rows = [(2 * k + i, *x[1:]) for k, x in enumerate(rows) for i in (0,)]
    metrics = spark.createDataFrame(rows, schema)
    features = lambda df: df.groupBy("ts").pivot("metric_name", ["a", "b"]).agg(F.first("value")).withColumn("key", F.unix_seconds("ts"))
    table = models.ModelTable(spark, str(tmp_path / "models"))
    zero = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    assert table.current() is None
    args = (("a", "b"), "key")
    assert models.refit(table, metrics, features(metrics), *args, now=zero + 400) == 1
    first = table.current()
    assert first.reason == "first" and first.trees is not None and {x.metric_name: round(x["mean"]) for x in first.baselines.collect()} == {"a": 10, "b": 10}
    # Nothing new, then a shift of one metric, then the clock.
    calm = metrics.unionByName(spark.createDataFrame([(2000 + k, "e", "a", r.gauss(10, 0.1), at(400 + k)) for k in range(200)], schema))
    assert models.refit(table, calm, features(calm), *args, now=zero + 700) is None and table.current().number == 1
    shifted = calm.unionByName(spark.createDataFrame([(3000 + k, "e", "a", r.gauss(30, 0.1), at(700 + k)) for k in range(600)], schema))
    assert models.refit(table, shifted, features(shifted), *args, now=zero + 1300) == 2
    second = table.current()
    assert second.reason == "drift" and {x.metric_name: round(x["mean"]) for x in second.baselines.collect()} == {"a": 30, "b": 10}
    assert models.refit(table, shifted, features(shifted), *args, now=zero + 1400) is None
    assert models.refit(table, shifted, features(shifted), *args, now=zero + 1300 + 3600) == 3 and table.current().reason == "clock"
    # Without rows since the last fit the forest stays.
    assert (table.current().trees.cut == second.trees.cut).all()
    # The first version is still whole; a version that was not pointed to is written over.
    assert spark.read.parquet(str(tmp_path / "models/version=1/baselines")).count() == 2
    (tmp_path / "models/version=4/baselines").mkdir(parents=True)
    assert table.current().number == 3 and table.publish(second.baselines, None, zero, "hand") == 4 and table.current().trees is None
    assert detect.zscore_score(metrics, first.baselines).count() == len(rows)


def test_late_rows_are_counted(spark, tmp_path):
    listener = late.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(listener)
    try:
        source = tmp_path / "in"
        source.mkdir()
        for k, seconds in enumerate(([0, 5000], [5001], [10, 70, 5002], [30, 9000])):
            (source / f"{k}.json").write_text("\n".join(json.dumps({"ts": str(at(s))}) for s in seconds))
            time.sleep(0.02)
        rows = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(str(source)).withWatermark("ts", "10 seconds")
        query = rows.groupBy(F.window("ts", "1 minute").alias("w")).count().writeStream.queryName("counts").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if (tmp_path / "late").exists() and late.late_rows(spark.read.schema(late.SCHEMA).parquet(str(tmp_path / "late"))).agg(F.sum("late_rows")).first()[0] == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = late.late_rows(spark.read.parquet(str(tmp_path / "late"))).collect()
    assert [(x["query"], x.operator, x.late_rows) for x in got] == [("counts", "stateStoreSave", 3)]
