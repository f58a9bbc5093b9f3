"""Security events, histogram points, typed batches and the feature reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of attack types.
ATTACKS = {
    "BRUTE_FORCE_ATTEMPT": "BRUTE_FORCE", "BRUTE_FORCE_ATTACK": "BRUTE_FORCE", "PRIVILEGE_ESCALATION_ATTEMPT": "PRIVILEGE_ESCALATION",
    "UNAUTHORIZED_CONFIG_CHANGE": "CONFIG_DRIFT", "POTENTIAL_DATA_EXFILTRATION": "DATA_EXFILTRATION",
}
#: Batch types whose log rows are errors unless they say otherwise.
ERROR_TYPES = ("siem", "security_alerts")
_FIELDS = {
    "event_id": ("event_id", "eventId"), "entity_id": ("entity_id", "entityId"), "attack_type": ("attack_type", "attackType"), "confidence": ("confidence",),
    "source_ip": ("source_ip", "sourceIp"), "description": ("description",), "timestamp": ("timestamp",),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def parse_security_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON objects to rows; fields with no column of their own stay in ``attributes``. Lines that are no object go."""
    rows = raw.select(F.from_json(value, "map<string,string>").alias("m")).where(F.col("m").isNotNull())
    field = lambda name: F.coalesce(*[F.element_at("m", alias) for alias in _FIELDS[name]])
    taken = [alias for names in _FIELDS.values() for alias in names]
    attack = _lookup(ATTACKS, F.coalesce(F.upper(F.trim(field("attack_type"))), F.lit("UNKNOWN_ATTACK")))
    share = F.least(F.greatest(F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    # A missing id is a hash of the row, so that a second reading gives the same id.
    name = F.sha2(F.to_json("m").cast("binary"), 256)
    at = F.coalesce(F.timestamp_millis(field("timestamp").try_cast("long")), F.try_to_timestamp(field("timestamp")))
    return rows.select(
        F.coalesce(field("event_id"), name).alias("event_id"), field("entity_id").alias("entity_id"), attack.alias("attack_type"), share.alias("confidence"), field("source_ip").alias("source_ip"),
        F.coalesce(field("description"), F.lit("")).alias("description"), at.alias("ts"), F.map_filter("m", lambda k, _: ~k.isin(*taken)).alias("attributes"),
    )


def explode_histograms(points: DataFrame) -> DataFrame:
    """One ``_sum`` row and one ``_bucket`` row per explicit bound (``entity_id, metric_name, ts, sum, bounds, counts``)."""
    base = ["entity_id", "ts"]
    total = points.select(*base, F.concat("metric_name", F.lit("_sum")).alias("metric_name"), F.col("sum").alias("value"), F.lit(None).cast("double").alias("le"))
    pairs = F.explode(F.slice(F.arrays_zip("bounds", "counts"), F.lit(1), F.size("bounds"))).alias("b")
    buckets = points.select(*base, F.concat("metric_name", F.lit("_bucket")).alias("metric_name"), pairs)
    return total.unionByName(buckets.select(*base, "metric_name", F.col("b.counts").cast("double").alias("value"), F.col("b.bounds").alias("le")))


def split_batches(batches: DataFrame, ingested_at: Column | None = None) -> dict[str, DataFrame]:
    """Typed batches (``type, entity_id, metrics, logs, traces`` with lists of structs whose ``timestamp`` is text) as three tables."""
    now = F.current_timestamp() if ingested_at is None else ingested_at
    at = F.coalesce(F.try_to_timestamp("x.timestamp"), now).alias("ts")
    rows = lambda c: batches.select("type", "entity_id", F.explode(c).alias("x"))
    level = F.coalesce("x.level", F.when(F.col("type").isin(*ERROR_TYPES), "ERROR").otherwise("INFO"))
    logs = rows("logs").select("entity_id", level.alias("log_level"), "x.message", at)
    bare = batches.where(F.col("type").isin("metadata", "state") & (F.coalesce(F.size("logs"), F.lit(0)) < 1))
    envelope = bare.select("entity_id", F.lit("INFO").alias("log_level"), F.concat(F.col("type"), F.lit(" batch")).alias("message"), now.alias("ts"))
    return {
        "metrics": rows("metrics").select("entity_id", F.col("x.name").alias("metric_name"), "x.value", at),
        "logs": logs.unionByName(envelope),
        "traces": rows("traces").select("entity_id", "x.trace_id", "x.span_id", "x.parent_span_id", "x.duration_ms", at),
    }


def read_features(vectors: DataFrame, entity_id: str, window_size: str | None = None, start=None, end=None) -> DataFrame:
    """Vectors of one entity within [start, end], oldest first; of the last day where no start is given."""
    rows = vectors.where(F.col("entity_id") == entity_id)
    if window_size is not None:
        rows = rows.where(F.col("window_size") == window_size)
    first = F.current_timestamp() - F.expr("INTERVAL 24 HOURS") if start is None else F.lit(start).cast("timestamp")
    rows = rows.where(F.col("window_start") >= first)
    return (rows if end is None else rows.where(F.col("window_end") <= F.lit(end).cast("timestamp"))).orderBy("window_start", "window_end")
