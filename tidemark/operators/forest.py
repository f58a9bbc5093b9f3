"""An isolation forest: trees from small samples, scored by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, TREES, LEAST = 256, 100, 100


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as heaps: node k has the children 2k + 1 and 2k + 2; a feature of -1 marks a leaf, whose ``cut`` is its path length."""

    mean: np.ndarray
    scale: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    sample: int
    offset: float = 0.0

    def normality(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / expected path): the greater, the more normal."""
        x = (np.where(np.isfinite(x), x, 0.0) - self.mean) / self.scale
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut in zip(self.feature, self.cut, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                right = x[rows[inner], feature[node[inner]]] >= cut[node[inner]]
                node[inner] = 2 * node[inner] + 1 + right
            total += cut[node]
        return -(2.0 ** -(total / len(self.feature) / max(float(_average_path(np.array(self.sample))), 1e-9)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.normality(x) - self.offset


def _grow(x: np.ndarray, depth: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    feature, cut = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.nonzero(low < high)[0]
        if level == depth or len(rows) < 2 or not len(open_):
            cut[node] = level + _average_path(np.array(len(rows)))
            continue
        feature[node] = f = random.choice(open_)
        cut[node] = at = random.uniform(low[f], high[f])
        right = x[rows, f] >= at
        todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature, cut


def fit_forest(features: DataFrame, columns: tuple[str, ...], key: str, trees: int = TREES, contamination: float = 0.05, seed: int = 42) -> Forest | None:
    """A forest from ``trees`` samples of ``ROWS`` rows, which are what the method learns from; None with fewer than ``LEAST`` rows.

    The samples are the rows with the smallest hashes of ``key``, so that they are the same each time.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    got = features.select(F.xxhash64(F.lit(seed), F.col(key)).alias("_h"), *values).orderBy("_h", *columns).limit(trees * ROWS).toPandas()
    if len(got) < LEAST:
        return None
    x = got[list(columns)].to_numpy(float)
    x = np.where(np.isfinite(x), x, 0.0)
    random = np.random.default_rng(seed)
    size = min(ROWS, len(x))
    depth = int(np.ceil(np.log2(size)))
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = (x - mean) / scale
    grown = [_grow(z[random.choice(len(z), size, replace=False)], depth, random) for _ in range(trees)]
    forest = Forest(mean, scale, np.stack([f for f, _ in grown]), np.stack([c for _, c in grown]), size)
    forest.offset = float(np.quantile(forest.normality(x), contamination))
    return forest


def forest_score(features: DataFrame, columns: tuple[str, ...], forest: Forest | None) -> DataFrame:
    """``features`` with ``forest_score`` between 0 and 1 (the greater, the odder), null without a forest."""
    if forest is None:
        return features.withColumn("forest_score", F.lit(None).cast("double"))
    shared = features.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack([c.to_numpy(float) for c in batch], axis=1)
            yield pd.Series(1 / (1 + np.exp(shared.value.decision(x))))

    values: list[Column] = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return features.withColumn("forest_score", score(*values))
