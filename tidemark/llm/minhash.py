"""MinHash near-duplicates: one-permutation hashing, optimal densification, stars in band buckets.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z folded). One hash deals
every shingle into one of ``BANDS`` x ``ROWS`` bins and orders it there; a bin's smallest value
is its signature. An empty bin takes the value of a bin that is not empty, which a hash of
the bin and of the number of the try picks, so that sets which agree agree there too. The
signatures of a band are one key. At a similarity of 0.85 one band agrees with a probability
of 0.377, so all 32 miss a pair with one of 3e-7.

Texts under one key are linked through its most frequent one (a star, so a bucket of n texts
makes n - 1 pairs), and what stars leave apart is compared further and exactly (see
``set_links``). All links are confirmed on whole sets.

Defined cases: a null or empty text has an empty set and is linked with nothing, other such
texts included; one of fewer words than a shingle is one shingle; equal texts are looked at
once; rows with an equal id keep a row each; a row without an id gets the smallest id of its
component, null if no member has one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paragraph_dedup, set_links
from .memory import tidy
from .storage import store

SHINGLE = 3
SIMILARITY = 0.85
BANDS, ROWS = 32, 6
#: Words that are signed together.
TOGETHER = 200_000
_EMPTY = np.iinfo(np.uint64).max
_GOLDEN, _OTHER, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _THIRD
    x = (x ^ (x >> np.uint64(29))) * _GOLDEN
    return x ^ (x >> np.uint64(32))


def signatures(h: np.ndarray, size: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``bins`` values for each set; ``h`` has the elements' hashes set by set, ``size`` (one or more) how many each has."""
    value = _mixed(h)
    place = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    value = _mixed(value + _OTHER) >> np.uint64(1)
    out = np.full(len(size) * bins, _EMPTY, np.uint64)
    np.minimum.at(out, np.repeat(np.arange(len(size)), size) * bins + place, value)
    out = out.reshape(len(size), bins)
    there = out != _EMPTY
    row, column = np.nonzero(~there)
    turn = 0
    while len(row):
        turn += 1
        picked = _mixed(column.astype(np.uint64) * _OTHER + np.uint64(turn * int(_GOLDEN) & 2**64 - 1))
        source = ((picked >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        ok = there[row, source]
        out[row[ok], column[ok]] = out[row[ok], source[ok]]
        row, column = row[~ok], column[~ok]
    return out


def band_keys(signed: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each set and band of ``rows`` values."""
    bands = signed.reshape(len(signed), -1, rows)
    key = np.tile(_mixed(np.arange(bands.shape[1], dtype=np.uint64)), (len(signed), 1))
    for k in range(rows):
        key = _mixed(key * _GOLDEN + bands[:, :, k])
    return key.view(np.int64)


def _text_rows(shingle: int):
    """Id, number of shingles and name of each row's folded words; the keys, and the words, of texts new to those handled together."""

    def rows(part: list[tuple]) -> pd.DataFrame:
        joined = [b" ".join(words) for _, words in part]
        ids = [paragraph_dedup.paragraph_key(x) for x in joined]
        count, new = Counter(ids), {x: k for k, x in enumerate(ids) if part[k][1]}
        keys: list = [None] * len(part)
        sizes: dict = {}
        if new:
            h, start = paragraph_dedup.Hashed([part[k][1] for k in new.values()]).shingles(shingle)
            size = np.diff(np.append(start, len(h)))
            for (x, at), key, own in zip(new.items(), band_keys(signatures(h, size)), np.split(h, start[1:]), strict=True):
                keys[at], sizes[x] = key, len(np.unique(own))
        return pd.DataFrame({
            "id": pd.Series([i for i, _ in part], dtype=object), "p": [p for p, _ in ids], "q": [q for _, q in ids], "n": [sizes.get(x, 0) for x in ids], "c": [count[x] for x in ids],
            "keys": pd.Series(keys, dtype=object), "words": [None if key is None else x for key, x in zip(keys, joined, strict=True)],
        })

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part, held = [], 0
            for i, text in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["text"], strict=True):
                part.append((i, (text or "").encode().lower().split()))
                held += len(part[-1][1])
                if held > TOGETHER:
                    yield rows(part)
                    part, held = [], 0
            if part:
                yield rows(part)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per row; component_id is the smallest id that links reach, and its row is kept."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = store(plain.mapInPandas(_text_rows(shingle), f"id {kind}, p long, q long, n long, c int, keys array<long>, words binary"), "minhash-texts")
    roots = set_links.linked(rows.where("keys is not null"), lambda words: paragraph_dedup.shingle_sets(words, shingle), similarity)
    named = rows.select("id", "n", "p", "q")
    some = named.where("n > 0").join(roots.withColumnRenamed("node", "p"), "p", "left")
    some = some.select("id", "n", F.coalesce("root", "p").alias("root"), F.when(F.col("root").isNull(), F.col("q")).otherwise(0).alias("q"))
    some = store(some, "minhash-classes")
    least = some.groupBy("root", "q").agg(F.min("id").alias("component_id"))
    found = some.join(least, ["root", "q"]).select("id", "n", "component_id")
    found = found.unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
