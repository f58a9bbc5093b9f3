"""Operators that are built another way than their definition, against the definition."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, features, graph, health
from tidemark.sources import otlp

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
POINTS = "event_id int, entity_id string, metric_name string, value double, ts timestamp"


def plain_cusum(values, mean, std, slack=0.5):
    pos = neg = 0.0
    for v in values:
        if v is not None:
            gap = v - mean
            dev = gap / std if std > 0 else math.copysign(math.inf, gap) if gap else 0.0
            # max(0.0, nan) is 0.0 here
            pos, neg = max(0.0, pos + dev - slack), max(0.0, neg - dev - slack)
        yield pos, neg


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_cusum_by_pieces(spark, block):
    """One hot series, small ones, nulls, and a series without a spread."""
    r = random.Random(3)
    rows = [(k, "hot", "m", None if k % 50 < 3 else r.gauss(0.2, 1), at(k // 2)) for k in range(700)]
    rows += [(1000 + k, "hot", "m", None, at(1000 + k)) for k in range(80)] + [(2000 + k, "hot", "m", r.gauss(-1, 1), at(2000 + k)) for k in range(60)]
    rows += [(3000 + k, f"e{k % 7}", "m", r.gauss(0, 2), at(k)) for k in range(100)]
    rows += [(4000 + k, "flat", "f", [5.0, 5.0, 6.0, 5.0, None, 4.0, 5.0, 7.0][k % 8], at(k)) for k in range(160)]
    base = spark.createDataFrame([("m", 0.0, 1.0), ("f", 5.0, 0.0)], "metric_name string, mean double, std double")
    df = spark.createDataFrame(rows, POINTS).repartition(6)
    got = {x.event_id: (x.s_pos, x.s_neg, x.drift) for x in detect.cusum_drift(df, base, block=block).collect()}
    assert len(got) == len(rows)
    for series in {(x[1], x[2]) for x in rows}:
        own = sorted((x for x in rows if (x[1], x[2]) == series), key=lambda x: (x[4], x[0]))
        mean, std = (0.0, 1.0) if series[1] == "m" else (5.0, 0.0)
        for x, (pos, neg) in zip(own, plain_cusum([x[3] for x in own], mean, std), strict=True):
            a, b, drift = got[x[0]]
            assert a == pytest.approx(pos, abs=1e-9) and b == pytest.approx(neg, abs=1e-9), x
            assert drift == (pos > 4 or neg > 4)
    assert got[4002][0] == math.inf and got[4003][0] == math.inf and got[4005] == (0.0, math.inf, True)


def test_cusum_pieces_are_many(spark):
    rows = spark.range(4000).select(F.col("id").cast("int").alias("event_id"), F.lit("e").alias("entity_id"), F.lit("m").alias("metric_name"), F.when(F.col("id") >= 0, 0.0).alias("dev"), F.lit(None).cast("double").alias("off"), F.timestamp_seconds("id").alias("ts"))
    found = detect._cusum_by_pieces(rows, 0.5)
    assert found.count() == 4000
    spans = rows.repartitionByRange(4, *detect.SERIES, "ts", "event_id").withColumn("piece", F.spark_partition_id())
    assert spans.select("piece").distinct().count() > 1


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_on_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = {(f"v{r.randrange(7)}", f"v{r.randrange(7)}", r.choice([1, 1, 2])) for _ in range(11)}
    edges = spark.createDataFrame([x for x in edges if x[0] != x[1]], "src string, dst string, layer int")
    symptoms = spark.createDataFrame([(f"v{k}",) for k in range(8)], "symptom string")
    every = graph.fault_paths(edges, symptoms)
    best = graph.best_paths(edges, symptoms)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(graph.score_root_causes(best)) == key(graph.score_root_causes(every))
    shortest = lambda df: key(df.groupBy("symptom", "root").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path")))
    assert shortest(best) == shortest(every)


def test_best_paths_that_turn_back(spark):
    """The shortest way with a causal edge from a goes to c and back; it is no path, and the longer path counts."""
    edges = [("c", "a", 2), ("c", "a", 1), ("a", "root", 1), ("a", "d", 1), ("e", "d", 2), ("e", "root", 1)]
    edges = spark.createDataFrame(edges, "src string, dst string, layer int")
    symptoms = spark.createDataFrame([("a",)], "symptom string")
    best = {(x.root, x.causal): x.path for x in graph.best_paths(edges, symptoms).collect()}
    assert best["root", False] == ["root", "a"] and best["root", True] == ["root", "e", "d", "a"]
    every = graph.fault_paths(edges, symptoms)
    assert graph.score_root_causes(graph.best_paths(edges, symptoms)).collect() == graph.score_root_causes(every).collect()


def test_best_paths_are_few(spark):
    """Nine complete layers of five nodes have two million paths from a symptom."""
    edges = [(f"{k}.{a}", f"{k + 1}.{b}", 2 if (k, a, b) == (4, 0, 0) else 1) for k in range(8) for a in range(5) for b in range(5)]
    edges = spark.createDataFrame([(d, s, layer) if layer == 2 else (s, d, layer) for s, d, layer in edges], "src string, dst string, layer int")
    found = graph.best_paths(edges, spark.createDataFrame([("0.0",), ("0.1",)], "symptom string")).collect()
    assert len(found) == 2 * 5 * 2 and {len(x.path) for x in found} == {9}


def test_absence_up_to_now(spark):
    rows = [(1, "gone", "up", 1.0, at(0)), (2, "gone", "up", 1.0, at(100)), (3, "here", "up", 1.0, at(86_300)), (4, "back", "up", 1.0, at(0)), (5, "back", "up", 1.0, at(86_000)), (6, "ahead", "up", 1.0, at(0)), (7, "ahead", "up", 1.0, at(90_000))]
    series = spark.createDataFrame(rows, POINTS)
    rule = [{"name": "down", "metric": "up", "kind": "absent", "seconds": 600}]
    got = {(x.entity_id, x.started, x.ended) for x in health.evaluate_alert_rules(series, rule, now=at(86_400)).collect()}
    assert got == {("gone", at(100), None), ("back", at(0), at(86_000)), ("ahead", at(0), None)}
    assert {x.entity_id for x in health.evaluate_alert_rules(series, rule).collect()} == {"back", "ahead"}


def test_quantile_rules_and_open_bucket(spark):
    inf = float("inf")
    rows = [("a", 1.0, 5), ("a", 2.0, 9), ("a", inf, 10), ("b", 1.0, 0), ("b", inf, 4), ("c", inf, 3), ("d", 1.0, 0), ("d", inf, 0)]
    buckets = spark.createDataFrame(rows, "entity_id string, le double, count long")
    assert {x.entity_id: x.quantile for x in health.histogram_quantile(buckets, 0.99).collect()} == {"a": 2.0, "b": 1.0, "c": None}
    assert health.histogram_quantile(buckets, 0.5).where("entity_id = 'a'").first().quantile == 1.0
    slow = spark.createDataFrame([(k, "e", "ms", 100.0 if 300 <= k < 900 and k % 10 == 0 else 1.0, at(k)) for k in range(1500)], POINTS)
    rule = [{"name": "slow", "metric": "ms", "kind": "quantile_above", "quantile": 0.95, "limit": 50.0, "seconds": 300}]
    assert [(x.started, x.ended) for x in health.evaluate_alert_rules(slow, rule).collect()] == [(at(300), at(600))]


def test_panes_keep_ranks(spark):
    """Windows of more values than the sketch holds; nulls; a pane without a value."""
    rows = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.lit("e").alias("entity_id"), F.lit("m").alias("metric_name"), F.when(F.col("id") % 100 > 0, F.pow(F.rand(5), F.lit(3)) * 1000 + 1e6).alias("value"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 600).alias("ts"), F.lit(False).alias("is_error"),
    ).persist()
    got = {x.window_start: x for x in features.sliding_by_panes(rows).collect()}
    want = {x.window_start: x for x in features.sliding_features(rows).collect()}
    assert got.keys() == want.keys() and len(got) == 14
    for start, x in got.items():
        y = want[start]
        assert (x["count"], x["min"], x["max"]) == (y["count"], y["min"], y["max"]) and x["count"] >= 5900
        assert x["avg"] == pytest.approx(y["avg"]) and x["stddev"] == pytest.approx(y["stddev"], rel=1e-9)
        values = sorted(v.value for v in rows.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start) + F.expr("INTERVAL 5 MINUTES")) & F.col("value").isNotNull()).select("value").collect())
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(sum(v <= x[name] for v in values) / len(values) - q) < 0.008, (name, start)
    none = spark.createDataFrame([(1, "e", "m", None, at(0), False)], POINTS + ", is_error boolean")
    assert {(x["count"], x.p50, x.avg, x.stddev) for x in features.sliding_by_panes(none).collect()} == {(0, None, None, None)}


def test_otlp_histogram_points(spark):
    line = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"user-service"}}]},"scopeMetrics":[{"metrics":[{"name":"g","unit":"1","gauge":{"dataPoints":[{"timeUnixNano":"1785307829000000000","asDouble":42.0,"attributes":[{"key":"method","value":{"stringValue":"GET"}}]}]}},{"name":"h","unit":"ms","histogram":{"dataPoints":[{"timeUnixNano":"1785307829000000000","count":100,"sum":5000.0,"explicitBounds":[10.0,50.0,100.0,500.0],"bucketCounts":["30",40,20,8,2]},{"timeUnixNano":"1785307829000000000"}]}}]}]}]}'
    got = [(x.metric_name, x.value, x.attributes) for x in otlp.parse_otlp_metrics(spark.createDataFrame([(line,)], "value string")).collect()]
    bucket = lambda b, n: ("h_bucket", float(n), {"bound": str(b), "count": str(n)})
    assert got == [("g", 42.0, {"method": "GET"}), ("h_sum", 5000.0, {"count": "100"}), bucket(10.0, 30), bucket(50.0, 40), bucket(100.0, 20), bucket(500.0, 8), ("h_sum", 0.0, {"count": "0"})]
