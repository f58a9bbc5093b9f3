"""Fitted models as versions of a table, with a pointer to the current one, and when to fit again."""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import detect, forest
from .topic import _Folder


@dataclass
class Version:
    number: int
    fitted_at: float
    reason: str
    baselines: DataFrame
    trees: forest.Forest | None


class ModelTable:
    """Versions under a folder. A version is written whole before the pointer is moved to it by a rename, so a reader sees the old one or the new one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path, self._folder = spark, path, _Folder(path)

    def _pointer(self) -> dict | None:
        return json.loads(self._folder.read("current.json")) if self._folder.there("current.json") else None

    def current(self) -> Version | None:
        found = self._pointer()
        if found is None:
            return None
        name = f"version={found['number']}"
        trees = pickle.loads(self._folder.read(f"{name}/forest")) if found["forest"] else None
        return Version(found["number"], found["fitted_at"], found["reason"], self._spark.read.parquet(f"{self._path}/{name}/baselines"), trees)

    def publish(self, baselines: DataFrame, trees: forest.Forest | None, now: float, reason: str) -> int:
        found = self._pointer()
        number = 1 if found is None else found["number"] + 1
        name = f"version={number}"
        # Of a version that was never pointed to, nothing counts.
        baselines.write.mode("overwrite").parquet(f"{self._path}/{name}/baselines")
        if trees is not None:
            self._folder.write(f"{name}/forest", pickle.dumps(trees))
        self._folder.write("current.json", json.dumps({"number": number, "fitted_at": now, "reason": reason, "forest": trees is not None}).encode())
        return number


def refit(table: ModelTable, metrics: DataFrame, features: DataFrame, columns: tuple[str, ...], key: str, now: float, every: float = 3600.0, last: int = 500) -> int | None:
    """Publish a new version if none is there, if a series has drifted since the last fit, or if that is ``every`` seconds ago; its number, or None.

    ``metrics`` (``ts`` up to ``now``) and ``features`` are what has been observed. Baselines come
    from the newest ``last`` values of each metric, the forest from the rows of ``features``
    (``columns``) since the last fit; a metric or a forest without rows stays as it was.
    """
    before = table.current()
    reason = "first" if before is None else "clock" if now - before.fitted_at >= every else None
    if reason is None:
        # Windows start again at each fit, so a drift that was answered does not fire again.
        since = metrics.where(F.col("ts") > F.timestamp_seconds(F.lit(before.fitted_at)))
        fired = detect.adwin_drift(since).where("drift").limit(1)
        reason = None if fired.isEmpty() else "drift"
    if reason is None:
        return None
    rank = F.row_number().over(W.partitionBy("metric_name").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = metrics.where("value IS NOT NULL").withColumn("_rank", rank).where(F.col("_rank") <= last)
    baselines = detect.zscore_baselines(recent)
    if before is not None:
        baselines = baselines.unionByName(before.baselines.join(baselines, "metric_name", "left_anti"))
        features = features.where(F.col("ts") > F.timestamp_seconds(F.lit(before.fitted_at))) if "ts" in features.columns else features
    trees = forest.fit_forest(features, columns, key) or (before.trees if before else None)
    return table.publish(baselines, trees, now, reason)
