"""Removal of repeated passages: paragraphs, exact and near, by MinHash bands.

Every line with a word is a paragraph. Its set of five-word shingles (case folded, A-Z) is
signed with ``BANDS`` x ``ROWS`` MinHash values; a line of fewer words is one shingle, so
that only its copies are like it. For a Jaccard similarity s a band collides with
probability s^ROWS, so at s = 0.8 the bands miss a pair with probability
(1 - 0.8^2)^8 = 0.0003, before a cluster's other pairs are counted.

A passage may also stand inside longer lines. So a line of more than ``LONG`` words is
besides cut into pieces: a cut is where the hash of a pair of words is smaller than the
``REACH`` before and no greater than those after (or ``MOST`` words after the last), which depends on the words around only, so that a passage is cut
alike in all lines that hold it. Pieces are compared for equality.

Paragraphs are known by a hash of their folded words, so exact copies are one paragraph
throughout. Paragraphs that meet in a band bucket are linked by the exact Jaccard similarity
of their shingle sets (see ``set_links``). Of each component, the first paragraph (by
document id, then text, then place) stays; the others are repeated. Repeated words that
follow each other are a passage, and it is removed if it has ``MIN_WORDS`` words or more:
the definition of a passage (a title or licence line of a few words is none), not a limit of
the search.

Defined cases: a null or empty text has no paragraphs; repeats inside one document are left
alone unless ``inside`` asks for them; rows with an equal id are one document each and keep a row each if their texts differ (equal
rows are merged); a null id sorts last; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .memory import tidy
from .set_links import linked
from .storage import store

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 2
LONG, REACH, MOST = 24, 6, 32
MIN_WORDS = 20
#: Words whose paragraphs are signed together.
TOGETHER = 200_000
#: Places of a paragraph above which (and above a HOT_KEYS-th of all places) it is joined by broadcast.
HOT, HOT_KEYS = 10_000, 10_000
_GENERATOR = np.random.default_rng(17)
_FACTOR = _GENERATOR.integers(1, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _GENERATOR.integers(0, 2**63, BANDS * ROWS, np.uint64)
_GOLDEN, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lines_of(text: str | None) -> list[list[bytes]]:
    """The folded words of each line that has some."""
    return [words for line in (text or "").encode().lower().split(b"\n") if (words := line.split())]


def paragraph_key(words: bytes) -> tuple[int, int]:
    """128 bits of the joined words, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(words)
    return (digest & 2**64 - 1) - 2**63, (digest >> 64) - 2**63


class _WordHashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > TOGETHER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _smallest_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` values from each place on."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :])


class Hashed:
    """Word hashes of paragraphs, one behind the other."""

    def __init__(self, paras: list[list[bytes]], hashes: dict | None = None) -> None:
        hashes = _WordHashes() if hashes is None else hashes
        self.size = np.fromiter(map(len, paras), np.int64, len(paras))
        self.flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(paras)), np.uint64, int(self.size.sum()))

    def only(self, these: np.ndarray) -> Hashed:
        """Those paragraphs where ``these`` is true."""
        out = Hashed([])
        out.size, out.flat = self.size[these], self.flat[np.repeat(these, self.size)]
        return out

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all paragraphs, and where each one's start; one shingle for fewer words than ``size``."""
        full = np.maximum(self.size, size)
        flat = self.flat
        if (self.size < size).any():
            # Short paragraphs are filled up with the hash of the empty word, which no text has.
            at = np.arange(len(flat)) + np.repeat(np.cumsum(full - self.size) - (full - self.size), self.size)
            flat = np.full(int(full.sum()), xxhash.xxh64_intdigest(b""), np.uint64)
            flat[at] = self.flat
        n = max(0, len(flat) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * _GOLDEN + flat[k : k + n]
        h = (h ^ (h >> np.uint64(32))) * _OTHER
        h ^= h >> np.uint64(32)
        left = np.repeat(np.cumsum(full), full)[:n] - np.arange(n)
        count = full - size + 1
        return h[left >= size], np.cumsum(count) - count

    def keys(self) -> np.ndarray:
        """One signed 64-bit key for each paragraph and band."""
        h, start = self.shingles()
        key = np.tile(np.arange(BANDS, dtype=np.uint64) * _GOLDEN, (len(self.size), 1))
        for k in range(ROWS):
            for band in range(BANDS):
                f = band * ROWS + k
                low = np.minimum.reduceat(h * _FACTOR[f] + _SHIFT[f], start) if len(start) else start.astype(np.uint64)
                mixed = (key[:, band] ^ (low >> np.uint64(7))) * _OTHER
                key[:, band] = mixed ^ (mixed >> np.uint64(32))
        return key.view(np.int64)

    def cuts(self) -> list[list[int]]:
        """Places before which each paragraph is cut, 0 and its end included."""
        # Paragraphs stand apart by more than REACH, so that none sees another.
        line = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(line)) + (line + 1) * (REACH + 1)
        pair = np.full(len(line) + (len(self.size) + 2) * (REACH + 1), np.iinfo(np.uint64).max)
        two = (self.flat[:-1] * _GOLDEN + self.flat[1:]) * _OTHER
        inside = line[1:] == line[:-1]
        pair[at[1:][inside]] = (two ^ (two >> np.uint64(29)))[inside]
        low = _smallest_of(pair, REACH)
        # The first of equal pairs counts, so that a word said many times over is not cut at each.
        cut = np.nonzero((pair[at] < low[at - REACH]) & (pair[at] <= low[at + 1]))[0]
        end = np.cumsum(self.size)
        begin = end - self.size
        parts = np.split(cut, np.searchsorted(cut, end[:-1])) if len(end) else []
        out = []
        for part, b, s in zip(parts, begin.tolist(), self.size.tolist(), strict=True):
            bounds = [0, *(part - b).tolist(), s]
            if s > MOST and max(map(int.__sub__, bounds[1:], bounds)) > MOST:
                # Words that repeat in a rhythm have no smallest pair: cut at equal steps from where they start.
                bounds = [x for a, e in zip(bounds[:-1], bounds[1:], strict=True) for x in range(a, e, MOST)] + [s]
            out.append(bounds)
        return out


_UNIT = "h long, start int, n int, k int, p long, q long, c int, keys array<long>, words binary"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph and piece, and one for each document, with ``k``, the number of its paragraphs.

    ``keys``, ``words`` and ``c`` (the number of its places) stand at the first place of a paragraph among documents that are handled together.
    """
    hashes = _WordHashes()

    def rows(batch: pa.RecordBatch, first: int, texts: list[list[list[bytes]]]) -> pa.RecordBatch:
        """The rows of the documents of ``batch`` from ``first`` on, with these lines."""
        known: dict[bytes, int] = {}
        paras: list[list[bytes]] = []
        numbers: list[int] = []
        for words in chain.from_iterable(texts):
            number = known.setdefault(b" ".join(words), len(paras))
            if number == len(paras):
                paras.append(words)
            numbers.append(number)
        lines = np.fromiter(map(len, texts), np.int64, len(texts))
        number = np.array(numbers, np.int64)
        size = np.fromiter(map(len, paras), np.int64, len(paras))
        of = np.repeat(np.arange(len(texts)), lines)  # the document of each line
        n = size[number]
        before = np.append(0, np.cumsum(n))
        start = before[:-1] - before[(np.cumsum(lines) - lines)[of]]
        joined = list(known)
        ids = np.array(list(map(paragraph_key, joined)), np.int64).reshape(-1, 2)
        signed = np.nonzero(size >= SHINGLE)[0]
        hashed = Hashed([paras[x] for x in signed.tolist()], hashes)
        keys = hashed.keys() if len(signed) else np.zeros((0, BANDS), np.int64)
        long = np.nonzero(size > LONG)[0].tolist()
        pieces: list[tuple] = []  # paragraph, start, size and key
        for x, cut in zip(long, hashed.only(hashed.size > LONG).cuts(), strict=True) if long else ():
            if len(cut) > 2:
                words = paras[x]
                pieces += [(x, a, b - a, *paragraph_key(b" ".join(words[a:b]))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        piece = np.array(pieces, np.int64).reshape(-1, 5)
        count = np.bincount(piece[:, 0], minlength=len(paras))
        # The pieces of each line's paragraph.
        line = np.repeat(np.arange(len(number)), count[number])
        each = np.arange(len(line)) - np.repeat(np.cumsum(count[number]) - count[number], count[number]) + (np.cumsum(count) - count)[number[line]]
        # Paragraphs with keys at their first line.
        at = np.unique(number, return_index=True)[1][signed]
        key_of = np.full(len(number), -1)
        key_of[at] = np.arange(len(signed))
        total = len(texts) + len(number) + len(line)
        place = np.append(key_of, np.full(len(line), -1))
        shown = pa.array(np.append(np.full(len(texts), -1), place), mask=np.append(np.ones(len(texts), bool), place < 0))
        no_doc = np.append(np.ones(len(texts), bool), np.zeros(total - len(texts), bool))
        column = lambda kind, lines_, pieces_: pa.array(np.concatenate([np.zeros(len(texts), np.int64), lines_, pieces_]), kind, mask=no_doc)
        docs = pa.array(first + np.concatenate([np.arange(len(texts)), of, of[line]]))
        offsets = np.arange(0, BANDS * len(signed) + 1, BANDS, dtype=np.int32)
        return pa.RecordBatch.from_arrays([
            batch.column("doc").take(docs), batch.column("h").take(docs),
            column(pa.int32(), start, start[line] + piece[each, 1]), column(pa.int32(), n, piece[each, 2]),
            pa.array(np.append(lines, np.zeros(total - len(texts), np.int64)), pa.int32(), mask=~no_doc),
            column(pa.int64(), ids[number, 0], piece[each, 3]), column(pa.int64(), ids[number, 1], piece[each, 4]),
            pa.array(np.bincount(number, minlength=len(paras))[signed], pa.int32()).take(shown),
            pa.ListArray.from_arrays(offsets, keys.ravel()).take(shown),
            pa.array([joined[x] for x in signed.tolist()], pa.binary()).take(shown),
        ], ["doc", "h", "start", "n", "k", "p", "q", "c", "keys", "words"])

    for batch in batches:
        held, texts, first = 0, [], 0
        for text in batch.column("text"):
            texts.append(lines_of(text.as_py()))
            held += sum(map(len, texts[-1]))
            if held > TOGETHER:
                yield rows(batch, first, texts)
                held, texts, first = 0, [], first + len(texts)
        if texts:
            yield rows(batch, first, texts)


def shingle_sets(words: Column, size: int = SHINGLE) -> Column:
    """The distinct shingles' hashes of folded words (binary), sorted."""

    @F.pandas_udf("array<long>")
    @tidy
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _WordHashes()
        for column in batches:
            out: list[np.ndarray] = []
            held, paras = 0, []
            for k, text in enumerate(column, 1):
                paras.append(text.split())
                held += len(paras[-1])
                if held > TOGETHER or k == len(column):
                    h, start = Hashed(paras, hashes).shingles(size)
                    out += [np.unique(part).view(np.int64) for part in np.split(h, start[1:])]
                    held, paras = 0, []
            yield pd.Series(out, dtype=object)

    return sets(words)


def similar(units: DataFrame, similarity: float = SIMILARITY, candidates: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the paragraphs of ``units`` (p, c, keys, words) that have a similar one; ``candidates`` (a, b) are compared besides the bands'."""
    return linked(units, shingle_sets, similarity, candidates)


def _passages(spans: Column, min_words: int) -> Column:
    """Runs (start, end) of at least ``min_words`` words that sorted (start, end) spans cover."""
    run = lambda acc: F.when(acc["b"] - acc["a"] >= min_words, F.array(F.struct(acc["a"].alias("start"), acc["b"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    step = lambda acc, x: F.when(
        x["start"] <= acc["b"], F.struct(acc["done"].alias("done"), acc["a"].alias("a"), F.greatest(acc["b"], x["end"]).alias("b"))
    ).otherwise(F.struct(F.concat(acc["done"], run(acc)).alias("done"), x["start"].alias("a"), x["end"].alias("b")))
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["done"], run(acc)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, inside: bool = False) -> DataFrame:
    """Per document: ``id_col, text_hash, n_paragraphs``, ``n_repeated`` (paragraphs and pieces that an earlier place has),
    ``passages`` (start, end) of words to remove, and ``kept_in``, the ids of the documents that keep what repeats. With ``inside``, what an earlier place of the same document has repeats too."""
    plain = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    kind = plain.schema["doc"].dataType.simpleString()
    units = store(plain.mapInArrow(tidy(_unit_rows), f"doc {kind}, {_UNIT}"), "paragraphs")
    places = units.where("p is not null").select("doc", "h", "start", "n", "p", "q")
    roots = similar(units.where("keys is not null"), similarity)
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "h", "start")
    # One row for each paragraph; what follows is joined to it and not to all of its places.
    counts = store(places.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")), "paragraph-counts")
    # Of paragraphs with equal first 64 bits, the first one only was compared with others.
    known = counts.join(roots.withColumnRenamed("node", "p"), "p")
    known = known.groupBy("p").agg(F.min(F.struct("q", "n", "first", "root")).alias("x")).select("p", "x.*")
    classes = known.groupBy("root").agg(F.min("first").alias("least"))
    near = known.join(classes, "root").select("p", "q", "n", F.col("least").alias("first"))
    alone = counts.where("n > 1").join(known.select("p", "q"), ["p", "q"], "left_anti").select("p", "q", "n", "first")
    many = store(near.unionByName(alone), "paragraph-firsts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most HOT_KEYS paragraphs are so frequent, which bounds what is broadcast.
    hot = F.col("n") > max(HOT, total // HOT_KEYS)
    frequent = F.broadcast(many.where(hot).select("p", "q", F.col("first").alias("often")))
    marked = places.join(frequent, ["p", "q"], "left")
    rest = marked.where("often is null").drop("often").join(many.where(~hot).select("p", "q", "first"), ["p", "q"])
    found = rest.unionByName(marked.where("often is not null").withColumnRenamed("often", "first"))
    later = order != F.col("first")
    if not inside:
        later = later & ~(F.col("doc").eqNullSafe(F.col("first.doc")) & F.col("h").eqNullSafe(F.col("first.h")))
    gone = found.where(later).select("doc", "h", "start", (F.col("start") + F.col("n")).alias("end"), F.col("first.doc").alias("keeper"))
    per = units.where("k is not null").select("doc", "h", "k").unionByName(gone, allowMissingColumns=True).groupBy("doc", "h").agg(
        F.max("k").alias("n_paragraphs"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.sort_array(F.collect_set("keeper")).alias("kept_in"),
    )
    return per.select(F.col("doc").alias(id_col), F.col("h").alias("text_hash"), "n_paragraphs", F.size("spans").alias("n_repeated"), _passages(F.col("spans"), min_words).alias("passages"), "kept_in")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, inside: bool = False) -> DataFrame:
    """``docs`` with the repeated passages, and the white space behind them, cut out of every text."""
    found = repeats(docs, id_col, text_col, similarity, min_words, inside).where(F.size("passages") > 0).select(F.col(id_col).alias("id"), F.col("text_hash").alias("h"), "passages")
    # One column holds the row, so that no name inside can meet one outside.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")[text_col]) == F.col("h"))
    # Words with the white space behind them; white space in front is a word of its own, and always stays.
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"(^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    front = F.when(F.col("row")[text_col].rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    kept = F.filter(words, lambda _, k: (k < front) | ~F.exists("passages", lambda x: (x["start"] <= k - front) & (k - front < x["end"])))
    text = F.when(F.col("passages").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, ""))
    joined = rows.join(found, same, "left").select("row", text.alias("text"))
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
