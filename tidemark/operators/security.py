"""Attack detection on security events, in event time."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..rules import ADMINS, AUTH_WORDS, ESCALATION


def auth_failures(events: DataFrame, fields: tuple[str, ...] = ("attack_type", "event_type", "message")) -> DataFrame:
    """Rows with a source whose type or text speaks of a failed login."""
    text = F.lower(F.concat_ws(" ", *[c for c in fields if c in events.columns]))
    said = reduce(lambda a, b: a | b, [text.contains(w) for w in AUTH_WORDS])
    return events.where(said & (F.coalesce("source_ip", F.lit("")) != ""))


def detect_brute_force(failures: DataFrame, n: int = 10, seconds: int = 300) -> DataFrame:
    """Sources with ``n`` failures inside the window before an event, its start excluded."""
    at = F.unix_micros("ts")
    w = W.partitionBy("source_ip").orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    rows = failures.withColumn("at", at).withColumn("failures", F.count(F.lit(1)).over(w)).drop("at")
    if "message" in failures.columns:
        last = W.partitionBy("source_ip").orderBy("ts", "event_id").rowsBetween(-4, 0)
        rows = rows.withColumn("evidence", F.collect_list("message").over(last))
    hits = rows.where(F.col("failures") >= n)
    return hits.withColumn("confidence", F.least(2 * F.col("failures"), F.lit(100))).withColumn("entity", F.concat(F.lit("brute-force-"), "source_ip"))


def detect_priv_escalation(events: DataFrame, text: str = "message") -> DataFrame:
    """Events whose text speaks of more rights, but for those of administrators."""
    admin = F.lower("entity_id").isin(*ADMINS)
    if "entity_type" in events.columns:
        admin = admin | F.coalesce(F.lower("entity_type").contains("admin"), F.lit(False))
    hits = events.where(F.col(text).rlike(ESCALATION) & ~F.coalesce(admin, F.lit(False)))
    return hits.withColumn("severity", F.lit("CRITICAL")).withColumn("confidence", F.lit(90))


def detect_data_exfil(traffic: DataFrame, ratio: float = 3.0, seconds: int = 60) -> DataFrame:
    """Rows above ``ratio`` times the mean of the entity's earlier rows in the window.

    Earlier is by time, then id. The mean is summed in that order from these rows alone: what is
    taken off a sum again leaves rounding errors, and infinities leave no number.
    """
    first = W.partitionBy("entity_id").orderBy("at", "event_id")
    rows = traffic.where(F.col("entity_id").isNotNull() & F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts"))
    # Time with the row's rank as a fraction far below half a microsecond: one order for both ends of the frame.
    rows = rows.withColumn("place", F.col("at") + F.rank().over(first) * F.lit(Decimal("1E-12")))
    mean = f"avg(outbound_bytes) OVER (PARTITION BY entity_id ORDER BY place RANGE BETWEEN {seconds * 1_000_000}.5 PRECEDING AND 0.000000000001 PRECEDING)"
    rows = rows.withColumn("baseline", F.expr(mean)).drop("at", "place")
    hits = rows.where((F.col("baseline") > 0) & (F.col("outbound_bytes") > ratio * F.col("baseline")))
    return hits.withColumn("severity", F.lit("HIGH")).withColumn("confidence", F.lit(85))


def aggregate_evidence(events: DataFrame, n: int = 5, fields: tuple[str, ...] = ("log", "message", "description")) -> DataFrame:
    """``evidence``: the first text that is not blank of each of the last ``n`` events of an entity and attack."""
    texts = [F.when(F.trim(c) != "", F.col(c)) for c in fields if c in events.columns]
    w = W.partitionBy("entity_id", "attack_type").orderBy("ts", "event_id").rowsBetween(-(n - 1), 0)
    return events.withColumn("evidence", F.collect_list(F.coalesce(*texts)).over(w))
