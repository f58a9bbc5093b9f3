"""Benchmark decontamination: test-set word windows found in training texts.

Only DataFrame functions are used. Every window of ``n`` consecutive benchmark words is
keyed by the hash of its first ``PREFIX`` words. A document row hashes the same number of
words at each of its positions, the hashes are looked up in the broadcast set of keys, and
each candidate position is verified word by word before it counts as a hit.

Defined cases: a null or empty text has no words and no hits; an empty benchmark hits
nothing; rows that repeat (same id and text) keep one result row each; a null id is a
value like any other; other columns of the inputs are ignored by ``contamination`` and
carried through by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that make its lookup key.
PREFIX = 5
#: Distinct benchmark windows up to which the set is broadcast (about 250 bytes each).
BROADCAST_WINDOWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII rows take Spark's faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def benchmark_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), F.array().cast("array<string>"))


def _key(words: Column, at, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)], F.lit(size))


def _keys(size: int) -> Column:
    """The key of ``size`` words at every position of ``w``, null where too few follow."""
    return F.transform("w", lambda _, i: F.when(i + size <= F.size("w"), _key(F.col("w"), i, size)))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """Distinct windows ``(win, key, prefix, items)`` of the benchmark texts."""
    words = benchmark.select(F.col(item_col).alias("item"), benchmark_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    windows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("win"))
    prefix = F.least(F.size("win"), F.lit(PREFIX))
    key = F.coalesce(*[F.when(prefix == size, _key(F.col("win"), F.lit(0), size)) for size in range(1, PREFIX + 1)])
    return windows.groupBy("win").agg(F.collect_set("item").alias("items")).select("win", "items", prefix.alias("prefix"), key.alias("key"))


def _hits(rows: DataFrame, windows: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``rows`` (id, h, w) to base rows (``size`` null) and verified hits (start, size, items)."""
    padded = [_keys(size) for size in sizes]
    keyed = rows.select("id", "h", "w", F.size("w").alias("n"), F.concat(F.array(F.lit(None).cast("long")), F.flatten(F.array(*padded))).alias("keys"))
    # The outer form, as from a plain explode Spark infers a size filter and pushes it, with
    # the whole expression inside, below the projection that computes the words once.
    places = keyed.select("id", "h", "w", "n", F.posexplode_outer("keys").alias("at", "key"))
    base = F.col("at") == 0  # the null key in front matches nothing, so that each input row keeps one row
    start = (F.col("at") - 1) % F.greatest("n", F.lit(1))
    same = F.slice(F.col("w"), start + 1, F.size("win")) == F.col("win")
    if small:
        found = places.join(F.broadcast(windows), "key", "left").where(base | F.col("win").isNotNull())
        hit = F.col("win").isNotNull() & same
        return found.select("id", "h", "n", base.alias("base"), F.when(hit, start).alias("start"), F.when(hit, F.size("win")).alias("size"), F.when(hit, F.col("items")).alias("items"))
    # A benchmark past the bound: narrow rows meet the keys by shuffle, and only the
    # documents with a candidate are shuffled to have their windows compared.
    near = places.select("id", "h", "at", "key").join(windows.select("key").distinct(), "key", "left_semi")
    near = near.withColumnsRenamed({"id": "id2", "h": "h2"})
    full = rows.select("id", "h", "w", F.size("w").alias("n")).dropDuplicates(["id", "h"])
    near = near.join(full, F.col("id2").eqNullSafe(F.col("id")) & (F.col("h2") == F.col("h")))
    hits = near.join(windows, "key").where(same)
    nothing = rows.select("id", "h", F.size("w").alias("n"), F.lit(True).alias("base"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    return nothing.unionByName(hits.select("id", "h", "n", F.lit(False).alias("base"), start.cast("int").alias("start"), F.size("win").alias("size"), "items"))


def _covered(spans: Column) -> Column:
    """Positions inside a union of (start, size) spans that is sorted by start."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["size"]).alias("end"),
        (acc["n"] + F.greatest(x["start"] + x["size"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def _summed(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, n: int, broadcast_windows: int) -> DataFrame:
    windows = benchmark_windows(benchmark, item_col, text_col, n)
    sizes = [r["prefix"] for r in windows.select("prefix").distinct().orderBy("prefix").collect()] or [PREFIX]
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), benchmark_words(F.col(text_col)).alias("w"))
    hits = _hits(rows, windows, sizes, small)
    return hits.groupBy("id", "h").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if("base").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("size").isNotNull(), F.struct("start", "size")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 13, one_in: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per distinct row (id and text): ``id_col, text_hash, n_words, spans, n_hit, items, contaminated, copies``.

    ``spans`` holds the (start, size) word windows found, ``copies`` the number of equal input rows. A row is contaminated if it has
    a hit word and at least one in ``one_in`` of its words is hit.
    """
    rows = _summed(docs, benchmark, id_col, text_col, item_col, n, broadcast_windows).withColumn("n_hit", _covered(F.col("spans")))
    flagged = rows.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
    return flagged.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "n_words", "spans", "n_hit", "items", "contaminated", "copies")


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words inside ``spans`` and the separators after them."""
    words, gaps = F.split(text, NOT_WORD_ANY_CASE), F.split(text, IS_WORD_ANY_CASE)
    words = F.array_remove(words, "")
    kept = F.transform(words, lambda w, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["start"] + s["size"])), F.lit("")).otherwise(F.concat(w, F.coalesce(F.get(gaps, i + 1), F.lit("")))))
    return F.concat(F.coalesce(F.get(gaps, F.lit(0)), F.lit("")), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 13, one_in: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents (``document``), or with the hit spans cut out of every text (``span``)."""
    found = contamination(docs, benchmark, id_col, text_col, item_col, n, one_in, broadcast_windows)
    found = found.where(F.col("contaminated") if mode == "document" else F.col("n_hit") > 0)
    found = found.select(F.col(id_col).alias("id"), F.col("text_hash").alias("h"), "spans")
    # One column holds the row, so that no name inside can meet one outside.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row")[text_col]
    same = F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h"))
    if mode == "document":
        return rows.join(found, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    cut = F.when(F.col("spans").isNull(), text).otherwise(_without(text, F.col("spans")))
    joined = rows.join(found, same, "left")
    return joined.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
