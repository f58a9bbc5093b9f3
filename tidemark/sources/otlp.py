"""Raw telemetry JSON to flat rows: every resource, scope, record and data point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>>>"
_POINT = f"struct<timeUnixNano:string,asDouble:double,asInt:string,asLong:string,attributes:{_ATTRIBUTES}>"
_HISTOGRAM = f"struct<timeUnixNano:string,count:string,sum:double,explicitBounds:array<double>,bucketCounts:array<string>,attributes:{_ATTRIBUTES}>"
_METRIC = f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<dataPoints:array<{_POINT}>>,histogram:struct<dataPoints:array<{_HISTOGRAM}>>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string>,traceId:string,spanId:string,attributes:{_ATTRIBUTES}>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>"
TRACES = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"


def attributes(col: Column) -> Column:
    """Key-value structs as a map of strings; of a repeated key the first value stays."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"])
    return F.aggregate(F.coalesce(col, F.array().cast(_ATTRIBUTES)), F.create_map().cast("map<string,string>"), lambda m, a: F.when(F.map_contains_key(m, a["key"]), m).otherwise(F.map_concat(m, F.create_map(a["key"], value(a["value"])))))


def _entity(attrs: Column) -> Column:
    return F.coalesce(F.element_at(attrs, "service.name"), F.element_at(attrs, "service.instance.id"))


def _time(nanos: Column) -> Column:
    return F.timestamp_micros((nanos.cast("decimal(20,0)") / 1000).cast("long"))


def _records(raw: DataFrame, schema: str, top: str, scope: str, record: str, value: str) -> DataFrame:
    rows = raw.select(F.explode(F.from_json(value, schema)[top]).alias("r"))
    rows = rows.select(attributes(F.col("r.resource.attributes")).alias("res"), F.explode(f"r.{scope}").alias("s"))
    return rows.select("res", F.explode(f"s.{record}").alias("x"))


def parse_otlp_metrics(raw: DataFrame, value: str = "value") -> DataFrame:
    """A row for each gauge and sum point, for each histogram's sum (``_sum``) and for each bucket with an explicit bound (``_bucket``, with ``bound`` and ``count`` among its attributes; a count that is missing is 0)."""
    rows = _records(raw, METRICS, "resourceMetrics", "scopeMetrics", "metrics", value)
    kind = "array<struct<name:string,value:double,at:string,attributes:map<string,string>>>"
    none = F.array().cast(kind)
    row = lambda suffix, value, at, own: F.struct(F.concat("x.name", F.lit(suffix)).alias("name"), value.cast("double").alias("value"), at.alias("at"), own.alias("attributes"))
    point = lambda p: row("", F.coalesce(p["asDouble"], p["asInt"].cast("double"), p["asLong"].cast("double")), p["timeUnixNano"], attributes(p["attributes"]))
    more = lambda p, **names: F.map_concat(F.map_filter(attributes(p["attributes"]), lambda k, _: ~k.isin(*names)), F.create_map(*[x for n, c in names.items() for x in (F.lit(n), c.cast("string"))]))

    def histogram(p: Column) -> Column:
        whole = row("_sum", F.coalesce(p["sum"], F.lit(0.0)), p["timeUnixNano"], more(p, count=F.coalesce(p["count"], F.lit("0"))))
        pairs = F.arrays_zip(F.coalesce(p["explicitBounds"], F.array().cast("array<double>")).alias("bound"), F.slice(F.coalesce(p["bucketCounts"], F.array().cast("array<string>")), F.lit(1), F.greatest(F.lit(0), F.coalesce(F.size(p["explicitBounds"]), F.lit(0)))).alias("count"))
        bucket = lambda b: row("_bucket", F.coalesce(b["count"], F.lit("0")), p["timeUnixNano"], more(p, bound=b["bound"], count=F.coalesce(b["count"], F.lit("0"))))
        return F.concat(F.array(whole), F.transform(pairs, bucket))

    each = lambda c, f: F.coalesce(F.transform(c, f).cast(kind), none)
    points = F.concat(each("x.gauge.dataPoints", point), each("x.sum.dataPoints", point), F.coalesce(F.flatten(F.transform("x.histogram.dataPoints", histogram)).cast(kind), none))
    rows = rows.select("res", "x.unit", F.explode(points).alias("p"))
    return rows.select(_entity(F.col("res")).alias("entity_id"), F.col("p.name").alias("metric_name"), "unit", "p.value", _time(F.col("p.at")).alias("ts"), "p.attributes")


def parse_otlp_logs(raw: DataFrame, value: str = "value") -> DataFrame:
    rows = _records(raw, LOGS, "resourceLogs", "scopeLogs", "logRecords", value)
    n = F.col("x.severityNumber")
    level = F.when(n.between(1, 4), "TRACE").when(n.between(5, 8), "DEBUG").when(n.between(9, 12), "INFO").when(n.between(13, 16), "WARN").when(n >= 17, "ERROR").otherwise(F.col("x.severityText"))
    return rows.select(_entity(F.col("res")).alias("entity_id"), level.alias("log_level"), F.col("x.body.stringValue").alias("message"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), _time(F.coalesce("x.timeUnixNano", "x.observedTimeUnixNano")).alias("ts"), attributes(F.col("x.attributes")).alias("attributes"))


def parse_otlp_traces(raw: DataFrame, value: str = "value") -> DataFrame:
    rows = _records(raw, TRACES, "resourceSpans", "scopeSpans", "spans", value)
    nanos = F.col("x.endTimeUnixNano").cast("decimal(20,0)") - F.col("x.startTimeUnixNano").cast("decimal(20,0)")
    status = F.when(F.col("x.status.code") == 1, "OK").when(F.col("x.status.code") == 2, "ERROR").otherwise("UNSET")
    named = F.transform_keys(attributes(F.col("x.attributes")), lambda k, _: F.concat(F.lit("span."), k))
    return rows.select(_entity(F.col("res")).alias("entity_id"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.col("x.parentSpanId").alias("parent_span_id"), F.col("x.name").alias("operation"), F.floor(nanos / 1_000_000).cast("long").alias("duration_ms"), status.alias("status"), _time(F.col("x.startTimeUnixNano")).alias("ts"), named.alias("attributes"))


def route_signal_type(raw: DataFrame, value: str = "value") -> DataFrame:
    has = lambda key: F.get_json_object(value, f"$.{key}").isNotNull()
    return raw.withColumn("signal", F.when(has("resourceMetrics"), "metrics").when(has("resourceLogs"), "logs").when(has("resourceSpans"), "traces").otherwise("events"))
