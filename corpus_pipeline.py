"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmarks, pieces.

In every stage a null text is an empty one, other columns are carried through whatever their
names, an empty table gives an empty one, and a row without an id is a document like any
other that comes after those with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_crf, piece_codec, simhash, suffix_dedup
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.storage import discard, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.5 or more; it learns from all labels.

    A text without a word scores 0 and goes; repeated rows score alike; without labels of
    both kinds the share of good ones (0.5 if there are none) is the score of every text.
    """
    field, prior = line_crf.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    kept = line_crf.scored(rows, field, prior).where("score >= 0.5")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts with a five-word Jaccard similarity of 0.8.

    Null ids come last; of equal ids, the text with the smallest hash stays; of rows with an
    equal id and text one stays; texts without a word are alike.
    """
    found = simhash.similar_documents(docs)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = found.groupBy("class").agg(F.min(order).alias("first"))
    gone = found.join(first, "class").where(order != F.col("first")).select("id", "h").distinct()
    twice = found.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "h")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("t"))
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("t") == F.col("h"))
    kept = rows.join(gone, same, "left_anti")
    repeated = kept.join(twice, same, "left_semi").dropDuplicates(["of", "t"])
    kept = kept.join(twice, same, "left_anti").unionByName(repeated)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has; texts with nothing left go.

    Texts that lose nothing stay as they are, null and empty ones too; of a character that a
    cut goes through, nothing stays.
    """
    found = suffix_dedup.deduplicated(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    text = F.when(F.col("_removed") == 0, F.col("text")).otherwise(suffix_dedup.whole_characters(F.col("_kept")))
    found = found.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    kept = found.where((F.col("_removed") == 0) | (F.length("text") > 0))
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; a text without a word is not, and an empty benchmark hits none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with merge-dropout, a row for each document; ``lossless`` says whether they decode to its text (null: to null)."""
    model = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.round_trip(docs, model, dropout=0.1, seed=7)
    lossless = F.col("text").eqNullSafe(F.col("decoded"))
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", lossless.alias("lossless"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmarks),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL has none of the field, fingerprints, suffix arrays and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage-{k + 1}")
            if k:
                discard(before)
            before = docs
    return docs
