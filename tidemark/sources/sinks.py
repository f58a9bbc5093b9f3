"""Table sinks: day-partitioned writes, keyed updates, retention, workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: what a workspace name looks like.
WORKSPACE = r"^[a-z0-9][a-z0-9\-_]{0,62}$"


def write_table(df: DataFrame, path: str, ts: str = "ts", sort: tuple[str, ...] = ("entity_id",)) -> None:
    """Append by day, sorted inside files so that entity filters skip row groups; a busy day is split."""
    # Lists leave as JSON, times in text become times.
    lists = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith("array")}
    times = {ts: F.try_to_timestamp(ts)} if dict(df.dtypes)[ts] == "string" else {}
    dated = df.withColumns(lists | times).withColumn("dt", F.to_date(ts))
    dated.repartition("dt", F.pmod(F.xxhash64(*sort), F.lit(16))).sortWithinPartitions("dt", *sort, ts).write.mode("append").partitionBy("dt").parquet(path)


def topic_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key, value`` of a topic: each row as JSON."""
    name = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    return df.select(name.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_stream_topic(df: DataFrame, topic: str, checkpoint: str, kafka: dict | None = None, key: str | None = None, writer: str | None = None):
    """A topic where the connector is installed (``kafka`` options; at least once), a topic folder with offsets (``writer``: the query's name in it; exactly once), else JSON lines in a folder."""
    rows = topic_rows(df, key)
    if kafka is not None:
        return rows.writeStream.format("kafka").options(topic=topic, checkpointLocation=checkpoint, **kafka).start()
    if writer is not None:
        from .topic import register

        register(df.sparkSession)
        return rows.writeStream.format("topic").options(path=topic, writer=writer, checkpointLocation=checkpoint).trigger(availableNow=True).start()
    return rows.select("value").writeStream.format("text").option("path", topic).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive_jsonl(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("dt", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def archive_entities_parquet(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("dt", F.date_format(ts, "yyyy-MM-dd-HH")).write.mode("append").partitionBy("dt").parquet(path)


def upsert_latest(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest of each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("_change")))
    rows = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_change")


def apply_retention(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def route_by_workspace(df: DataFrame, attribute: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid workspace slug in their attributes, and the others."""
    rows = df.withColumn("workspace", F.element_at("attributes", attribute))
    valid = F.coalesce(F.col("workspace").rlike(WORKSPACE), F.lit(False))
    return rows.where(valid), rows.where(~valid)
