"""Structured Streaming jobs: the batch operators behind a watermark and a checkpoint.

A job that needs more than one result from a batch, or joins it with stored tables, runs
its operators in ``foreachBatch``. A batch that is run again after a failure overwrites the
folder of its number, so that results stay those of one run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import normalize as N
from ..operators import change, entities, features, incidents, policy, resources, security
from ..plans.detection import enriched, score_points
from ..plans.response import built_incidents
from ..sources import ingest, otlp, topic
from . import state


def read_stream(spark: SparkSession, source: str, schema: str, kafka: dict | None = None, log: bool = False) -> DataFrame:
    """A topic where the connector is installed (``kafka`` options), a topic folder with offsets (``log``), else a folder of Parquet files."""
    if kafka is not None:
        return spark.readStream.format("kafka").options(subscribe=source, **kafka).load()
    if log:
        topic.register(spark)
        return spark.readStream.format("topic").option("path", source).load()
    return spark.readStream.schema(schema).parquet(source)


def _each_batch(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _keyed(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A query with keyed state that appends to a folder."""
    with state.rocksdb(df.sparkSession):
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _write(df: DataFrame, out: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def ingest_job(raw: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Telemetry JSON (``value``) to normalised tables for each signal, and a day-wise archive of them all."""

    def run(batch: DataFrame, number: int) -> None:
        batch = otlp.route_signal_type(batch).persist()
        of = lambda name: batch.where(F.col("signal") == name)
        now = F.current_timestamp()
        metrics = otlp.parse_otlp_metrics(of("metrics"))
        metrics = metrics.withColumn("value", N.metric_value(F.col("value"), F.col("unit")))
        logs = otlp.parse_otlp_logs(of("logs")).withColumns({"log_level": N.log_severity(F.col("log_level")), "message": N.log_body(F.col("message"))})
        logs = logs.withColumn("entity_type", N.entity_type(F.lit(None).cast("string"), F.col("entity_id")))
        traces = otlp.parse_otlp_traces(of("traces"))
        traces = traces.withColumns({c: N.hex_id(F.col(c), n) for c, n in (("trace_id", 32), ("span_id", 16))})
        events = ingest.parse_security_events(of("events"))
        archive = None
        for name, rows in (("metrics", metrics), ("logs", logs), ("traces", traces), ("events", events)):
            rows = N.validated(rows, now).withColumn("attributes", N.k8s_context(F.col("attributes")))
            _write(rows, f"{out}/{name}", number)
            line = rows.select(F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.to_json(F.struct(F.lit(name).alias("signal"), *rows.columns)).alias("value"))
            archive = line if archive is None else archive.unionByName(line)
        archive.write.mode("overwrite").partitionBy("dt").text(f"{out}/archive/batch={number}")
        batch.unpersist()

    return _each_batch(raw, checkpoint, run, trigger or {"availableNow": True})


def feature_job(metrics: DataFrame, out: str, checkpoint: str, size: str = "5 minutes", lateness: str = "5 seconds") -> StreamingQuery:
    """Closed tumbling windows, appended once each; later rows than the lateness are dropped."""
    windows = features.tumbling_features(metrics.withWatermark("ts", lateness), size)
    return windows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feature_jobs(metrics: DataFrame, out: str, checkpoint: str, sizes: tuple[str, ...] = ("1 minute", "5 minutes", "15 minutes"), lateness: str = "5 seconds") -> dict[str, StreamingQuery]:
    """Tumbling windows of each size, sliding windows and sessions, one query each."""
    late = metrics.withWatermark("ts", lateness)
    tables = {f"tumbling-{size.replace(' ', '-')}": features.tumbling_features(late, size) for size in sizes}
    tables |= {"sliding": features.sliding_features(late), "sessions": features.session_bursts(late)}
    start = lambda name, df: df.writeStream.outputMode("append").format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return {name: start(name, df) for name, df in tables.items()}


def vector_job(windows: DataFrame, out: str, checkpoint: str, lateness: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Vectors of closed windows, merged in keyed state over all windows of the entity so far."""
    return _keyed(state.vectors(windows, lateness), out, checkpoint, trigger)


def entity_job(sightings: DataFrame, out: str, checkpoint: str, ttl_seconds: int = 300, lateness: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Entities (``raw_id, ts``) by canonical id with tags, one row for each active window, which may span batches."""
    parsed = lambda df, raw: df.withColumn("id", resources.parse_resource_id(raw))
    rows = parsed(sightings.select("raw_id", "ts"), F.col("raw_id")).select("raw_id", "ts", "id.*")
    rows = rows.withColumn("entity_id", entities.canonical_entity_id(F.col("provider"), F.col("entity_type"), F.col("name"), F.col("raw_id")))
    windows = parsed(state.entity_windows(rows, ttl_seconds, lateness), F.element_at("raw_ids", 1))
    tagged = windows.withColumn("tags", resources.business_tags(F.col("id.entity_type"), F.col("id.name"))).drop("id")
    return _keyed(tagged, out, checkpoint, trigger)


def relationship_job(spans: DataFrame, out: str, checkpoint: str, within: str = "10 minutes", lateness: str = "5 seconds") -> StreamingQuery:
    """Calls from a stream of spans joined with itself; state lasts for ``within`` beyond the watermark."""
    late = spans.withWatermark("ts", lateness)
    child = late.where("parent_span_id != ''").select(F.col("trace_id").alias("trace"), F.col("parent_span_id").alias("parent"), F.col("span_id").alias("child_span"), F.col("service_name").alias("dst"), F.col("duration_ms").alias("latency_ms"), F.col("ts").alias("child_ts"))
    parent = late.select("trace_id", "span_id", F.col("service_name").alias("src"), F.col("ts").alias("parent_ts"))
    span = F.expr(f"INTERVAL {within}")
    same = (F.col("trace") == F.col("trace_id")) & (F.col("parent") == F.col("span_id")) & (F.col("src") != F.col("dst"))
    near = F.col("child_ts").between(F.col("parent_ts") - span, F.col("parent_ts") + span)
    calls = child.join(parent, same & near).select("trace_id", "child_span", "src", "dst", F.lit("CALLS").alias("type"), "latency_ms")
    return calls.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect_job(points: DataFrame, history: DataFrame, out: str, checkpoint: str, edges: DataFrame | None = None, model=None, trigger: dict | None = None) -> StreamingQuery:
    """Scores of each batch of metric points against stored history; ``signal_job`` reads what it writes."""

    def run(batch: DataFrame, number: int) -> None:
        _write(score_points(batch, history, edges, model), out, number)

    return _each_batch(points, checkpoint, run, trigger)


def signal_job(scored: DataFrame, nodes: DataFrame, out: str, checkpoint: str, lateness: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Signals that are no noise, and sessions as they grow, of a stream of scored points; what a series has seen is kept between batches."""
    found = state.sessions_and_noise(scored, lateness=lateness)
    schema = scored.schema

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        kept = batch.where("kind = 'signal' AND keep").select(F.from_json("payload", schema).alias("row")).select("row.*")
        _write(enriched(kept, nodes), f"{out}/signals", number)
        _write(batch.where("kind = 'session'").drop("kind", "event_id", "keep", "payload"), f"{out}/sessions", number)
        batch.unpersist()

    with state.rocksdb(scored.sparkSession):
        return _each_batch(found, checkpoint, run, trigger)


def absence_job(metrics: DataFrame, out: str, checkpoint: str, seconds: int, lateness: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Series that have been silent for ``seconds``, and their gaps once they are back."""
    return _keyed(state.absences(metrics, seconds, lateness), out, checkpoint, trigger)


def security_job(spark: SparkSession, events: DataFrame, approved: DataFrame, history: str, out: str, checkpoint: str, seconds: int = 300) -> StreamingQuery:
    """Attacks in each batch of security events, with the events of the last ``seconds`` before it from ``history``, which the batch joins.

    The history's index has the times of each batch, so only batches that reach into those ``seconds`` are read.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/rows/batch={number}")
        span = batch.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("number", F.lit(number))
        span.coalesce(1).write.mode("overwrite").parquet(f"{history}/spans/batch={number}")
        first = span.first()["first"]
        if first is None:
            return
        start = F.lit(first) - F.expr(f"INTERVAL {int(seconds)} SECONDS")
        spans = spark.read.parquet(f"{history}/spans").where((F.col("number") <= number) & (F.col("last") >= start))
        paths = [f"{history}/rows/batch={x.number}" for x in spans.select("number").collect()]
        near = spark.read.schema(batch.schema).parquet(*paths).where(F.col("ts") >= start)
        found = {
            "BRUTE_FORCE": security.detect_brute_force(security.auth_failures(near), seconds=seconds),
            "CONFIG_DRIFT": change.detect_config_drift(near, approved),
            "PRIVILEGE_ESCALATION": security.detect_priv_escalation(near),
        }
        if "outbound_bytes" in near.columns:
            found["DATA_EXFILTRATION"] = security.detect_data_exfil(near)
        hits = change.classify_security(near, found)
        _write(hits.join(batch.select("event_id"), "event_id", "left_semi"), out, number)

    return _each_batch(events, checkpoint, run)


def incident_job(signals: DataFrame, nodes: DataFrame, edges: DataFrame, out: str, checkpoint: str, logs: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Incidents of each batch of signals over the graph's tables; ``response_job`` reads what it writes."""

    def run(batch: DataFrame, number: int) -> None:
        _write(built_incidents(batch, nodes, edges, logs), out, number)

    return _each_batch(signals, checkpoint, run, trigger)


def response_job(built: DataFrame, actions: DataFrame, out: str, checkpoint: str, ttl_seconds: int = 300, lateness: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Open incidents with their duplicates counted over batches, and routed actions and approvals for those that have just been opened."""
    found = state.open_incidents(built, ttl_seconds, lateness)
    schema = built.schema

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _write(batch.drop("payload"), f"{out}/incidents", number)
        opened = batch.where("status = 'opened'").select(F.from_json("payload", schema).alias("row"), F.col("impact").alias("most")).select("row.*", "most")
        opened = opened.withColumn("impact", F.col("most").cast(schema["impact"].dataType)).drop("most")
        routed = policy.route_actions(opened, policy.policy_decisions(opened, actions))
        _write(routed, f"{out}/actions", number)
        _write(policy.pending_approvals(routed), f"{out}/approvals", number)
        batch.unpersist()

    with state.rocksdb(built.sparkSession):
        return _each_batch(found, checkpoint, run, trigger)


def learning_job(results: DataFrame, out: str, checkpoint: str, incident_table: DataFrame | Callable[[], DataFrame] | None = None, since=None) -> StreamingQuery:
    """Knowledge rows of each batch of action results; with ``incident_table``, the repeated incidents at the time too.

    A function is called for each batch, so that it reads the table as it is then.
    """

    def run(batch: DataFrame, number: int) -> None:
        _write(policy.feedback_to_knowledge(batch), f"{out}/knowledge", number)
        if incident_table is not None:
            rows = incident_table() if callable(incident_table) else incident_table
            _write(incidents.mine_patterns(rows, since=since), f"{out}/patterns", number)

    return _each_batch(results, checkpoint, run)
