"""SimHash near-duplicates by deletion-variant segment signatures.

Two 64-bit fingerprints that differ in at most two bits agree, in at least one of their two
32-bit halves, up to one bit. So every distinct fingerprint is indexed under 64 variants: a
half with one of its bits wildcarded. Fingerprints that meet under an equal variant are
joined and verified by their bit distance, and components are taken over the links.

A variant under which more than ``PAIR_LIMIT`` distinct fingerprints meet is not paired.
Its members are linked through neighbours instead, which is exact and linear: fingerprints
at most two bits apart share a value that is at most one bit from both, and all
fingerprints one bit around a value are at most two bits apart from each other.

Defined cases: a null or empty text has fingerprint zero; equal fingerprints share one
index entry, so that copies cost nothing; a null id keeps its row but cannot become a
component id; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paragraph_dedup
from .components import connected_components
from .memory import give_back, release, tidy
from .storage import discard, store

SEED = 42
#: Distinct fingerprints under one variant up to which all pairs are compared.
PAIR_LIMIT = 16
HALF = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text, as a signed 64-bit number."""
    # bytes.lower and bytes.split know ASCII only, as the definition asks.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` per row."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
        give_back()

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp"))


def variants(fp: Column) -> Column:
    """64 keys: number of the wildcarded bit above the half without it."""
    half = lambda k: F.when(k < 32, fp.bitwiseAND(F.lit(HALF))).otherwise(F.shiftrightunsigned(fp, 32))
    masks = F.array(*[F.lit((HALF & ~(1 << (k % 32)))).cast("long") for k in range(64)])
    return F.transform(masks, lambda mask, k: half(k).bitwiseAND(mask).bitwiseOR(k.cast("long") * (1 << 32)))


def _neighbours(fp: Column) -> Column:
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    return F.transform(flips, lambda flip: fp.bitwiseXOR(flip))


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(a, b)`` that connect all distinct ``fp`` at most two bits apart."""
    from pyspark.sql import Window

    # The outer explode: see decontaminate about filters inferred from a plain one.
    entries = fps.select("fp", F.explode_outer(variants(F.col("fp"))).alias("key"))
    met = entries.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    met = store(met, "simhash-variants")
    few = met.where(F.col("n") <= PAIR_LIMIT).select("key", "fp")
    pairs = few.join(few.withColumnRenamed("fp", "other"), "key").where("fp < other")
    near = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = met.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    around = many.select("fp", F.explode_outer(_neighbours(F.col("fp"))).alias("key"))
    centre = around.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    near_many = around.join(centre, "key").where("fp != b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(near_many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)`` per row; component_id is the smallest id reachable by links."""
    rows = store(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(fps.select("fp")))
    classed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classed = store(classed, "simhash-classes")
    names = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classed.join(names, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _text_rows(shingle: int):
    """Id, hash of the text, fingerprint and key of the folded words of each row, and what ``paragraph_dedup.similar`` takes of texts new to the batch."""

    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                folded = [(t or "").encode().lower().split() for t in part["text"]]
                joined = [b" ".join(words) for words in folded]
                ids = [paragraph_dedup.paragraph_key(x) for x in joined]
                count, new = Counter(ids), {x: k for k, x in enumerate(ids) if folded[k]}
                keys: list = [None] * len(part)
                for at, key in zip(new.values(), paragraph_dedup.Hashed([folded[k] for k in new.values()]).keys() if new else (), strict=True):
                    keys[at] = key
                fps = [fingerprint(t, shingle) for t in part["text"]]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "h": part["h"].to_numpy(), "fp": np.array(fps, np.int64),
                    "p": [p for p, _ in ids], "q": [q for _, q in ids], "c": [count[x] for x in ids],
                    "keys": pd.Series(keys, dtype=object), "words": [None if key is None else x for key, x in zip(keys, joined, strict=True)],
                })

    return rows


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``(id, h, class)`` per row: rows of one class are connected by texts of that exact Jaccard similarity of five-word shingles.

    Candidates are texts with fingerprints at most two bits apart, and those that share a
    MinHash band: at a similarity of 0.8, 64-bit fingerprints differ in about ten bits, for
    which no segments of them are both few and selective. ``h`` is the hash of the row's text.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, h long, fp long, p long, q long, c int, keys array<long>, words binary"
    rows = store(plain.mapInPandas(_text_rows(paragraph_dedup.SHINGLE), schema), "simhash-texts")
    texts = rows.select("fp", "p").distinct()
    first = store(texts.groupBy("fp").agg(F.min("p").alias("least")), "simhash-prints")
    equal = texts.join(first, "fp").where("p != least").select(F.col("least").alias("a"), F.col("p").alias("b"))
    near = links(first.select("fp"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    candidates = equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b")
    # Texts without a word have no shingles; they are all alike.
    candidates = store(candidates, "simhash-candidates")
    release(docs.sparkSession)
    roots = paragraph_dedup.similar(rows.where("keys is not null"), similarity, candidates)
    found = rows.select("id", "h", "p", "q").join(roots.withColumnRenamed("node", "p"), "p", "left")
    found = store(found.select("id", "h", F.struct(F.coalesce("root", "p").alias("root"), F.when(F.col("root").isNull(), F.col("q")).alias("q")).alias("class")), "near-classes")
    for table in (rows, first, candidates):
        discard(table)
    return found
