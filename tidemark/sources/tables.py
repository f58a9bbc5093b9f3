"""Observability tables over the driver's star schema, columns pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, entity_id, metric_name, value, ts, is_error`` from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("metric_name"), "value",
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_error"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return e.select("event_id", F.col("user_id").cast("string").alias("entity_id"), level.alias("log_level"), F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("ts"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a trace (an order) in line order; each has the one before it as its parent."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.withColumn("n", n).select(
        F.col("l_orderkey").alias("trace_id"), F.col("n").cast("string").alias("span_id"),
        F.when(F.col("n") == 1, "").otherwise((F.col("n") - 1).cast("string")).alias("parent_span_id"),
        F.concat(F.lit("svc-"), "l_suppkey").alias("service_name"), F.col("l_quantity").alias("duration_ms"), F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first.isin("1", "2", "3"), F.concat(F.lit("P"), first)).otherwise("P4")
    return o.select(
        F.col("o_orderkey").alias("incident_id"), severity.alias("severity"), F.col("o_custkey").cast("string").alias("root_cause_entity"),
        (F.col("o_totalprice") / 5000).alias("impact"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("root_cause_entity"), F.col("l_returnflag").alias("outcome"), F.col("l_linestatus").alias("action_type"), F.col("l_linenumber").cast("long").alias("success_count"))


def _pick(key: str, *values: str):
    """The value whose place is ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_id, ts``: cloud resource ids of several kinds, one for each customer."""
    key = F.col("c_custkey").cast("string")
    front = _pick("c_custkey", "projects/p1/zones/us-central1-a/instances/vm-", "arn:aws:ec2:eu-west-1:123:instance/payment-", "i-0000abcd", "arn:aws:rds:us-east-1:12:db:postgres-", "k8s:pod:shop/frontend-", "azure:vm:checkout-", "projects/p/instances/mysql-", "k8s:service:shop/catalog-", "odd id ")
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(front, key).alias("raw_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 7).alias("ts"))


def security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events with types, texts, sources and traffic."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.when(F.col("user_id") % 10 == 0, "admin").otherwise(F.concat(F.lit("user-"), "user_id")).alias("entity_id"),
        F.when(F.col("user_id") % 7 == 0, "ADMIN_NODE").otherwise("API_NODE").alias("entity_type"),
        _pick("event_id", "sudo bash", "config_file_changed", "login failed", "Unauthorized config of host change", "all well", "role_change asked", "resume", "").alias("message"),
        F.when(F.col("event_type") == "error", "AUTH_FAILURE").otherwise("NONE").alias("event_type"),
        F.concat(F.lit("chg-"), F.col("event_id") % 50).alias("change_id"), F.concat(F.lit("10.0.0."), F.col("user_id") % 20).alias("source_ip"),
        F.col("value").alias("outbound_bytes"), F.col("ts").cast("timestamp").alias("ts"),
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("anomaly_id"), F.col("user_id").cast("string").alias("entity_id"), F.when(F.col("event_type") == "error", "security").otherwise("performance").alias("source_type"),
        _pick("event_id", "BRUTE_FORCE", "CONFIG_DRIFT", "DATA_EXFILTRATION").alias("attack_type"), _pick("event_id", "HIGH", "LOW", "CRITICAL", "MEDIUM").alias("severity"),
        F.when(F.col("event_id") % 3 == 0, "active").otherwise("resolved").alias("status"),
        F.when(F.col("user_id") % 20 == 3, "unknown").when(F.col("user_id") % 20 == 4, "").otherwise(F.concat(F.lit("10.0.0."), F.col("user_id") % 20)).alias("source_ip"),
        "value", F.col("ts").cast("timestamp").alias("ts"),
    )


def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    names = lambda by: F.transform(F.slice(F.array(*[F.lit(k) for k in range(7)]), 1, (F.col("o_orderkey") % by).cast("int")), lambda k: F.concat(F.lit("svc-"), k))
    return o.select(
        F.col("o_orderkey").alias("incident_id"), F.concat(F.lit("svc-"), F.col("o_custkey") % 50).alias("root_cause_entity"),
        _pick("o_custkey", "API_NODE", "DATABASE_NODE", "SERVICE", "K8S_RESOURCE", "INFRASTRUCTURE").alias("entity_type"), (F.col("o_orderkey") * 37 % 101).cast("double").alias("confidence"),
        (F.col("o_orderkey") * 13 % 100 / 100).alias("anomaly_score"), names(6).alias("impacted_services"), names(5).alias("fault_path"), names(7).alias("log_snippets"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    decided = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return o.select(
        F.concat(F.lit("apr-"), "o_orderkey").alias("approval_id"), F.col("o_orderkey").alias("incident_id"), _pick("o_custkey", "block_ip", "rollback").alias("action_type"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), decided.alias("decided_at"),
    )


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("kb-"), "o_orderkey").alias("kb_id"), F.concat(F.lit("svc-"), F.col("o_custkey") % 50).alias("root_cause_entity"), F.col("o_orderpriority").alias("resolution_summary"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("n"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), _pick("s_nationkey", "SERVICE", "DATABASE", "INFRASTRUCTURE", "ODD").alias("entity_type"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("anomaly_score"), F.when(F.col("s_suppkey") % 3 == 0, "team-a").when(F.col("s_suppkey") % 3 == 1, "team-b").alias("workspace"), F.lit("HIGH").alias("criticality"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of suppliers: each depends on the one with a third of its key; every fourth edge is a causal one, from cause to effect."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0")
    low, high, causal = F.concat(F.lit("n"), F.col("s_suppkey")), F.concat(F.lit("n"), F.floor(F.col("s_suppkey") / 3).cast("long")), F.col("s_suppkey") % 4 == 0
    return s.select(F.when(causal, high).otherwise(low).alias("src"), F.when(causal, low).otherwise(high).alias("dst"), F.when(causal, 2).otherwise(1).alias("layer"))
