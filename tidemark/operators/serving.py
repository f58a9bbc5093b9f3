"""Dashboard queries: filters, counts and top-k."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def resolve_hours(value: str | int | None) -> int | None:
    """``24``, ``24h`` or ``7d`` as hours; bad values give 24, more than 720 gives 720."""
    if value is None:
        return None
    found = re.fullmatch(r"(\d+)\s*([hd]?)", str(value).strip().lower())
    hours = int(found[1]) * (24 if found[2] == "d" else 1) if found else 0
    return min(hours, 720) if hours > 0 else 24


def newest(table: DataFrame, ts: str, limit: int = 50, since=None, most: int = 500, **equal) -> DataFrame:
    """Newest rows, ``most`` at most, under equality filters that are not None; filters reach the scan."""
    for name, value in equal.items():
        if value is not None:
            table = table.where(F.col(name) == value)
    if since is not None:
        table = table.where(F.col(ts) >= since)
    return table.orderBy(F.desc(ts), *sorted(c for c, kind in table.dtypes if c != ts and not kind.startswith("map"))).limit(max(1, min(limit, most)))


def severity_distribution(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def incidents_timeline(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "severity").agg(F.count(F.lit(1)).alias("n"))


def knowledge_stats(knowledge: DataFrame) -> DataFrame:
    """Counts in total, by outcome and by action in one pass over grouping sets."""
    rows = knowledge.groupingSets([[], ["outcome"], ["action_type"]], "outcome", "action_type")
    return rows.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def last_seen(events: DataFrame) -> DataFrame:
    """Latest time of each workspace (where there is one), entity and kind of telemetry, newest first."""
    keys = [c for c in ("workspace", "entity_id", "metric_name") if c in events.columns]
    return events.groupBy(*keys).agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), *keys)


def select_by_entity(tables: dict[str, DataFrame], name: str, entity_id: str, limit: int = 50) -> DataFrame:
    """Newest rows of an entity from one of the ``tables`` that may be asked for."""
    if name not in tables:
        raise PermissionError(f"no table {name}")
    table = tables[name]
    key = "entity_id" if "entity_id" in table.columns else "root_cause_entity"
    ts = next(c for c in ("ts", "created_at", "window_start") if c in table.columns)
    return newest(table, ts, limit, **{key: entity_id})


def summary_counts(incidents: DataFrame, anomalies: DataFrame, knowledge: DataFrame, since=None) -> DataFrame:
    """One row: incidents, active anomalies and knowledge rows, at or after ``since``."""
    counts = []
    for name, table, ts in (("total_incidents", incidents, "created_at"), ("active_anomalies", anomalies.where("status = 'active'"), "ts"), ("knowledge_base_entries", knowledge, "created_at")):
        rows = table if since is None else table.where(F.col(ts) >= since)
        counts.append(rows.agg(F.count(F.lit(1)).alias(name)))
    return counts[0].join(counts[1]).join(counts[2])  # one row each


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, table in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def security_anomalies(anomalies: DataFrame, limit: int = 50, since=None) -> DataFrame:
    return newest(anomalies, "ts", limit, since, source_type="security")


def attack_sources(anomalies: DataFrame, limit: int = 50, since=None) -> DataFrame:
    """Security anomalies by source; of attack types and severities the first in order."""
    rows = anomalies.where("source_type = 'security'").where(~F.coalesce("source_ip", F.lit("")).isin("", "unknown"))
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    found = rows.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), F.min("attack_type").alias("attack_type"), F.min("severity").alias("severity"), F.max("ts").alias("last_seen"))
    return found.orderBy(F.desc("n"), "source_ip").limit(max(1, min(limit, 200)))


def search_knowledge(knowledge: DataFrame, text: str = "", limit: int = 50, since=None) -> DataFrame:
    """Newest knowledge rows whose entity or summary contains ``text``; a blank text finds all."""
    if text.strip():
        knowledge = knowledge.where(F.col("root_cause_entity").contains(text) | F.col("resolution_summary").contains(text))
    return newest(knowledge, "created_at", limit, since)


def remediation_history(knowledge: DataFrame, approvals: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest knowledge rows and the newest decided approvals."""
    return newest(knowledge, "created_at", limit), newest(approvals.where("status != 'pending'"), "decided_at", limit)


def recent_per_entity(logs: DataFrame, n: int = 150, by: str = "entity_id") -> DataFrame:
    """The newest ``n`` rows of every entity (or of every ``workspace``): a ranked limit that Spark prunes before the shuffle."""
    w = W.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return logs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


#: Nodes of a parsed text that only read: what is not here (commands, scripts, table functions, time travel) is denied.
_READS = frozenset({
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias",
    "Union", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition", "Window",
})
#: Groups of built-in functions that compute from their arguments alone.
_PURE = frozenset({
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs",
    "predicate_funcs", "sketch_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
})


def _denied(spark: SparkSession, plan, tables: frozenset[str] | None) -> str | None:
    """What in a parsed plan is not allowed, if anything is."""
    seq = lambda x: [x.apply(k) for k in range(x.size())]
    registry = spark._jsparkSession.sessionState().functionRegistry()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    plans, expressions, named, known = [plan], [], [], set()
    while plans or expressions:
        if plans:
            node = plans.pop()
            kind = node.getClass().getSimpleName()
            if kind not in _READS:
                return kind
            if kind == "UnresolvedRelation":
                named.append([str(x) for x in seq(node.multipartIdentifier())])
            if kind == "UnresolvedWith":
                inner = seq(node.innerChildren())
                known |= {x.alias().lower() for x in inner}
                plans += inner
            plans += seq(node.children())
            expressions += seq(node.expressions())
            continue
        node = expressions.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction" or kind == "UnresolvedGenerator":
            name = [str(x) for x in seq(node.nameParts())] if kind == "UnresolvedFunction" else [node.name().funcName()]
            found = registry.lookupFunction(identifier(name[-1].lower())) if len(name) == 1 else None
            if found is None or found.isEmpty() or found.get().getGroup() not in _PURE:
                return ".".join(name)
        if any(x in kind for x in ("Subquery", "Exists", "ListQuery")):
            plans.append(node.plan()) if kind != "InSubquery" else expressions.append(node.query())
        expressions += seq(node.children())
    for name in named:
        # Two parts could be a format and a path; a view or table of the session has one.
        if len(name) != 1 or name[0].lower() not in known and tables is not None and name[0].lower() not in tables:
            return ".".join(name)
    return None


def safe_sql(spark: SparkSession, sql: str, limit: int = 100, tables: Iterable[str] | None = None) -> tuple[DataFrame, bool]:
    """The first rows of a query, and whether it has more. Whatever is not a plain query is denied.

    The text is parsed, not run, and its plan is walked, subqueries and common table expressions
    too: each node must be one that reads, each function a built-in that computes from its
    arguments alone, each relation a view or table of the session (of ``tables``, where they are
    given) and never a path. The query then runs once, for one row more than the limit.
    """
    limit = max(1, min(limit, 500))
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise PermissionError("read-only queries only") from error
    denied = _denied(spark, plan, None if tables is None else frozenset(x.lower() for x in tables))
    if denied:
        raise PermissionError(f"read-only queries only: {denied}")
    found = spark.sql(sql)
    rows = found.limit(limit + 1).collect()
    return spark.createDataFrame(rows[:limit], found.schema), len(rows) > limit
