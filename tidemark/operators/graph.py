"""Service dependencies, layered edges, fault paths and root-cause scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import normal_cdf
from ..sources.lineage import cut


def dependency_edges(traces: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Calls between services from each span and its parent; the busiest ``limit`` of those at or after ``since``, where these are given."""
    if since is not None:
        traces = traces.where(F.col("ts") >= since)
    child = traces.where("parent_span_id != ''").select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("service_name").alias("dst"), "duration_ms")
    parent = traces.select("trace_id", "span_id", F.col("service_name").alias("src"))
    calls = child.join(parent, ["trace_id", "span_id"]).where("src != dst")
    edges = calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("avg_ms"), *[F.percentile("duration_ms", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    return edges if limit is None else edges.orderBy(F.desc("calls"), "src", "dst").limit(limit)


def top_entities(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nodes with the greatest anomaly score; nodes without one go."""
    return nodes.where("anomaly_score is not null").orderBy(F.desc("anomaly_score"), "id").limit(max(1, min(k, 100)))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbor"), F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("neighbor"), F.lit("in").alias("direction")))


def merge_layers(edges: DataFrame) -> DataFrame:
    """Layer 2 stays; a layer 1 edge goes if layer 2 joins the same pair either way."""
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    causal = edges.where("layer = 2")
    rest = edges.where("layer = 1").withColumn("pair", pair)
    return causal.unionByName(rest.join(causal.select(pair.alias("pair")).distinct(), "pair", "left_anti").drop("pair"))


def _upstream(edges: DataFrame) -> DataFrame:
    """``node, next, strong``: layer 1 edges lead from a caller to what it depends on, layer 2 edges from a cause to its effect; upstream follows the former and reverses the latter."""
    one = F.col("layer") == 1
    up = edges.select(F.when(one, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(one, F.col("dst")).otherwise(F.col("src")).alias("next"), (~one).alias("strong"))
    return up.groupBy("node", "next").agg(F.max("strong").alias("strong"))


def best_paths(edges: DataFrame, symptoms: DataFrame, max_depth: int = 10) -> DataFrame:
    """Of the ``fault_paths`` of each symptom and root the shortest with and the shortest without a causal edge, as far as a score can tell them.

    All symptoms advance together, and of all ways to a node with one ``causal`` flag only the
    shortest (of equal ones, the first in order) goes on: as many rows as there are pairs of
    symptom and node, where the number of paths grows with their length's power. The shortest
    way is a path, but one that turns back to take a causal edge is not; such an end is looked
    up among all paths, if its score could be the best of its root.
    """
    up = _upstream(edges)
    now = symptoms.select("symptom", F.col("symptom").alias("node"), F.lit(False).alias("causal"), F.array("symptom").alias("path")).distinct()
    seen = now
    for _ in range(max_depth - 1):
        steps = now.join(up, "node").select("symptom", F.col("next").alias("node"), (F.col("causal") | F.col("strong")).alias("causal"), F.concat(F.array("next"), "path").alias("path"))
        steps = steps.groupBy("symptom", "node", "causal").agg(F.min("path").alias("path"))
        now = cut(steps.join(seen, ["symptom", "node", "causal"], "left_anti"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    ends = cut(seen.join(up, "node", "left_anti").select("symptom", F.col("node").alias("root"), "path", "causal"))
    simple = F.size(F.array_distinct("path")) == F.size("path")
    good = ends.where(simple)
    plain = good.groupBy("symptom", "root").agg(F.max(_path_score(F.col("path"), F.col("causal"))).alias("has"))
    turns = ends.where(~simple).join(plain, ["symptom", "root"], "left").where(_path_score(F.col("path"), F.col("causal")) > F.coalesce("has", F.lit(0.0))).select("symptom", "root")
    if turns.isEmpty():
        return good
    all_paths = fault_paths(edges, turns.select("symptom").distinct(), max_depth).where("causal").join(turns, ["symptom", "root"], "left_semi")
    found = all_paths.groupBy("symptom", "root", "causal").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))
    return good.unionByName(found)


def fault_paths(edges: DataFrame, symptoms: DataFrame, max_depth: int = 10) -> DataFrame:
    """Simple paths from each symptom up to nodes with nothing upstream, root first.

    All symptoms advance together, one join a step, for at most ``max_depth`` nodes; each step is
    written, as all later ones read it. ``causal``: the path has a layer 2 edge. Their number can
    grow with a power of the depth; scores need ``best_paths`` only.
    """
    up = _upstream(edges)
    now = symptoms.select("symptom", F.col("symptom").alias("node"), F.array("symptom").alias("path"), F.lit(False).alias("causal"))
    done = None
    for depth in range(max_depth):
        ends = now.join(up, "node", "left_anti").select("symptom", "path", "causal")
        done = ends if done is None else done.unionByName(ends)
        if depth < max_depth - 1:
            steps = now.join(up, "node").where(~F.array_contains("path", F.col("next")))
            now = cut(steps.select("symptom", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), (F.col("causal") | F.col("strong")).alias("causal")))
            if now.isEmpty():
                break
    return done.select("symptom", F.element_at("path", -1).alias("root"), F.reverse("path").alias("path"), "causal")


def _path_score(path, causal):
    n = F.size(path)
    anchor = F.when(causal, 0.85).otherwise(0.55)
    return F.when(n < 2, 0.2).otherwise(F.round(anchor * (0.6 + 0.4 * F.greatest(F.lit(0.0), 1 - 0.12 * (n - 1))), 3))


def score_root_causes(paths: DataFrame) -> DataFrame:
    """Roots of each symptom by the confidence of their best path (``fault_paths`` or ``best_paths``): more with a causal edge, less with its length, 0.2 without an edge."""
    score = _path_score(F.col("path"), F.col("causal"))
    best = paths.select("symptom", "root", score.alias("confidence")).groupBy("symptom", "root").agg(F.max("confidence").alias("confidence")).where("confidence >= 0.3")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("symptom").orderBy(F.desc("confidence"), "root")))


def lagged_correlation_edges(series: DataFrame, max_lag: int = 15, least: float = 0.5, least_rows: int = 4, significance: float = 0.05) -> DataFrame:
    """For each entity and ordered pair of its metrics (entity, metric, idx, value) the lag with the strongest correlation.

    A correlation counts from ``least`` on, and if Fisher's z over n - 3 makes chance no
    likelier than ``significance``; a lag leaves at least ``least_rows`` (four, for n - 3) pairs.
    """
    cause = series.select("entity_id", F.col("metric_name").alias("cause"), F.col("idx").alias("at"), F.col("value").alias("x"))
    cause = cause.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("idx", F.col("at") + F.col("lag"))
    effect = series.select("entity_id", F.col("metric_name").alias("effect"), "idx", F.col("value").alias("y"))
    pairs = cause.join(effect, ["entity_id", "idx"]).where("cause != effect")
    # A constant side has no correlation.
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    found = pairs.groupBy("entity_id", "cause", "effect", "lag").agg(r.alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_rows) & F.col("r").isNotNull())
    best = found.groupBy("entity_id", "cause", "effect").agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("b"))
    strength = F.atanh(F.least(F.abs("r"), F.lit(1 - 1e-12))) * F.sqrt(F.col("n") - 3)
    rows = best.select("entity_id", "cause", "effect", "b.lag", "b.r", "b.n").where(F.abs("r") >= least)
    return rows.withColumn("p", 2 * (1 - normal_cdf(strength))).where(F.col("p") <= significance)
