"""Normalisation of raw telemetry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import SERVICE_TYPES

#: The levels that log severities are folded to.
SEVERITY = {f"{level}{n}": level for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL") for n in ("", 2, 3, 4)}
SEVERITY |= {"NOTICE": "INFO", "WARNING": "WARN", "CRITICAL": "FATAL", "ALERT": "FATAL", "EMERGENCY": "FATAL"}


def metric_value(value: Column, unit: Column, exact: bool = False) -> Column:
    """Bytes to MiB and sub-second times to seconds; the first unit that is contained wins.

    ``exact`` compares whole units, so that ``transactions`` is no nanosecond.
    """
    u = F.lower(F.coalesce(unit, F.lit("1")))
    has = lambda *words: [u == w if exact else u.contains(w) for w in words]
    byte, milli, micro, nano = (has(*w) for w in (("byte", "by"), ("ms", "milli"), ("us", "micro"), ("ns", "nano")))
    return F.when(byte[0] | byte[1], value / 1048576).when(milli[0] | milli[1], value / 1e3).when(micro[0] | micro[1], value / 1e6).when(nano[0] | nano[1], value / 1e9).otherwise(value)


def log_severity(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(F.trim(level))), F.lit("INFO"))


def log_body(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def hex_id(raw: Column, size: int) -> Column:
    """Lower-case hex digits only: the last ``size``, or padded with zeros in front."""
    digits = F.regexp_replace(F.lower(raw), "[^0-9a-f]", "")
    return F.lpad(F.right(digits, F.lit(size)), size, "0")


def span_status(code: Column) -> Column:
    return F.when(code == "1", "OK").when(code == "2", "ERROR").otherwise("UNSET")


def confidence(v: Column) -> Column:
    """0..1 and 0..100 inputs to 0..100."""
    scaled = F.when(v <= 1, v * 100).when(v < 2, F.lit(100.0)).otherwise(v)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(3 - z))


def entity_type(given: Column, service: Column) -> Column:
    """The type named by the first known part of a service name, where none but API_NODE is given."""
    name = F.lower(service)
    found = F.coalesce(*[F.when(name.contains(part), F.lit(kind)) for part, kind in SERVICE_TYPES], F.lit("API_NODE"))
    return F.when((given.isNull() | (given == "API_NODE")) & service.isNotNull(), found).otherwise(given)


def validated(rows, now: Column, source: str = "performance"):
    """Rows with an entity; types, source and times that are missing get their defaults."""
    rows = rows.where(F.coalesce(F.col("entity_id"), F.lit("")) != "")
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    time = F.when(F.unix_micros("ts") > 0, F.col("ts")).otherwise(now)
    return rows.withColumns({"entity_type": F.coalesce(has("entity_type"), F.lit("API_NODE")), "source_type": F.coalesce(has("source_type"), F.lit(source)), "ts": time})


def k8s_context(attributes: Column) -> Column:
    """``k8s.namespace``, ``pod``, ``container`` and ``node`` from the attributes that end in ``name``, unless they are there."""
    base = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    for part in ("namespace", "pod", "container", "node"):
        key, name = F.lit(f"k8s.{part}"), F.element_at(base, f"k8s.{part}.name")
        base = F.when(F.map_contains_key(base, key) | name.isNull(), base).otherwise(F.map_concat(base, F.create_map(key, name)))
    return base


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)
