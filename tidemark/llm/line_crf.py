"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a label, good or bad. A line is described by its own features
and those of the line before and after it; neighbouring labels interact by transition
weights. Training lines take the label of their document. The score of a document is the
mean of its lines' forward-backward marginals for good, weighted by length in bytes.

The field is fitted on the driver, on at most ``SAMPLE`` labelled documents (those with the
smallest id hash), whose line features are computed by Spark; scoring runs over all rows.

Defined cases: a text without words scores 0; without labelled rows of both kinds every text
with words scores the share of good labels (0.5 if there are none); null labels and labels
without a document are ignored; repeated rows keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release, tidy

SAMPLE = 6_000
ROUNDS = 250
RIDGE = 1e-3
#: Bytes of text whose lines are described together.
CHUNK = 250_000

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>", "shout": b"!?", "space": b" \t\r\x0b\x0c", "mark": b".,;:'\"()-"}
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES.values(), 1):
    _KIND[list(_chars)] = _k
_KINDS = len(_CLASSES) + 1
WIDTH = 14


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), length in bytes and text number of every line with a word."""
    lines: list[bytes] = []
    of: list[int] = []
    repeat: list[tuple[int, int, bool]] = []
    for k, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if found := line.split():
                lines.append(line)
                of.append(k)
                repeat.append((len(found), len(set(found)), line in seen))
                seen.add(line)
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, np.int64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    n = np.bincount(np.repeat(np.arange(len(lines)) * _KINDS, size) + _KIND[data], minlength=len(lines) * _KINDS).reshape(-1, _KINDS).astype(float)
    _, upper, lower, digit, symbol, shout, space, mark = n.T
    counted = np.array(repeat, float)
    words, distinct, again = counted.T
    chars = np.maximum(size - space, 1)
    last = data[np.cumsum(size) - 1]
    features = np.stack([
        np.log1p(size), np.log1p(words), chars / words / 10, upper / np.maximum(upper + lower, 1), digit / chars,
        symbol / words, shout / words, mark / words, n[:, 0] / chars, np.isin(last, list(b".!?:\"")),
        1 - distinct / words, (1 - distinct / words) * np.log1p(words), again, np.minimum(symbol / words, 1) > 0.5,
    ], axis=1)
    return features, size.astype(float), np.array(of, np.int64)


@dataclass
class Field:
    """Weights of the features of a line and its two neighbours, and of label pairs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray  # [label before, label]; 1 is good

    def inputs(self, features: np.ndarray, of: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        out = np.zeros((len(x), 3 * WIDTH + 3))
        out[:, :WIDTH], out[:, -1] = x, 1
        same = np.nonzero(of[1:] == of[:-1])[0]
        out[same + 1, WIDTH : 2 * WIDTH], out[same + 1, -2] = x[same], 1
        out[same, 2 * WIDTH : 3 * WIDTH], out[same, -3] = x[same + 1], 1
        return out

    def messages(self, unary: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward (with own unary) and backward log odds of good for every line; chains advance together."""
        w = self.pairs
        ahead, back = unary.copy(), np.zeros(len(unary))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
        for t in range(1, longest):
            at = first[: alive[t]] + t
            r = ahead[at - 1]
            ahead[at] = unary[at] + np.logaddexp(w[0, 1], r + w[1, 1]) - np.logaddexp(w[0, 0], r + w[1, 0])
        for t in range(longest - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            s = unary[at + 1] + back[at + 1]
            back[at] = np.logaddexp(w[1, 0], s + w[1, 1]) - np.logaddexp(w[0, 0], s + w[0, 1])
        return ahead, back


def _chains(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0] if len(of) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(of)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(features: np.ndarray, of: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with a ridge, by Adam; ``label`` is 0 or 1 for each line."""
    field = Field(features.mean(0), features.std(0) + 1e-6, np.zeros(3 * WIDTH + 3), np.zeros((2, 2)))
    x = field.inputs(features, of)
    first, size = _chains(of)
    chains, inner = len(first), np.nonzero(of[1:] == of[:-1])[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner].astype(int), label[inner + 1].astype(int)), 1)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ field.weights
        ahead, back = field.messages(unary, first, size)
        gradient = x.T @ (label - _sigmoid(ahead + back))
        r, s = ahead[inner], unary[inner + 1] + back[inner + 1]
        joint = np.stack([np.full(len(r), field.pairs[0, 0]), s + field.pairs[0, 1], r + field.pairs[1, 0], r + s + field.pairs[1, 1]])
        joint = np.exp(joint - joint.max(0, initial=-np.inf, keepdims=True)) if len(r) else joint
        expected = (joint / joint.sum(0)).sum(1) if len(r) else np.zeros(4)
        gradient = np.concatenate([gradient, seen.ravel() - expected]) / chains - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def score_texts(texts: list[bytes], field: Field | None, prior: float = 0.5) -> np.ndarray:
    features, size, of = describe(texts)
    if field is None:
        good = np.full(len(size), prior)
    else:
        ahead, back = field.messages(field.inputs(features, of) @ field.weights, *_chains(of))
        good = _sigmoid(ahead + back)
    total = np.bincount(of, weights=size, minlength=len(texts))
    return np.where(total > 0, np.bincount(of, weights=size * good, minlength=len(texts)) / np.maximum(total, 1), 0.0)


def score_column(column: pd.Series, field: Field | None, prior: float = 0.5) -> np.ndarray:
    """Scores of a batch of texts, of which ``CHUNK`` bytes are described at a time."""
    parts, chunk, held = [np.zeros(0)], [], 0
    for text in column:
        chunk.append((text or "").encode())
        held += len(chunk[-1])
        if held > CHUNK:
            parts.append(score_texts(chunk, field, prior))
            chunk, held = [], 0
    if chunk:
        parts.append(score_texts(chunk, field, prior))
    return np.concatenate(parts)


def learn(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[Field | None, float]:
    """The field fitted on a bounded sample of the labels where ``use`` holds, and the share of good ones."""
    rows = labels.where(use & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)  # bounded, so it may be broadcast

    @tidy
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [describe([(t or "").encode()])[0] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "y": batch["y"], "x": [f.ravel() for f in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "text", F.col("_y").alias("y"))
    learned = _fitted(texts.mapInPandas(lines, f"id {kind}, y int, x array<double>"))
    release(docs.sparkSession)
    return learned


def _fitted(lines: DataFrame) -> tuple[Field | None, float]:
    """The field of ``lines`` (id, y, x), which are brought to the driver, and the share of good ones."""
    got = lines.toPandas().sort_values("id", kind="stable")
    x = [np.asarray(v).reshape(-1, WIDTH) for v in got["x"]]
    y = got["y"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    count = np.array([len(v) for v in x])
    return fit(np.concatenate(x), np.repeat(np.arange(len(x)), count), np.repeat(y, count)), float(y.mean())


def scored(docs: DataFrame, field: Field | None, prior: float = 0.5, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((field, prior))

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(score_column(column, *shared.value))

    return docs.withColumn(score_col, score(F.col(text_col)))
