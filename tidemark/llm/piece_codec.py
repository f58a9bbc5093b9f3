"""Encoding to and decoding from SentencePiece ids, with seeded merge-dropout.

A text is the pieces of its units: a run of spaces with the characters that follow it, past
whose ends no piece of the model reaches. Units are encoded together. In every round each
unit takes the best candidate from its agenda (highest score, then leftmost) and merges it.
A candidate is skipped if a hash keyed by seed, document id, the unit's place in its text
and the candidate's span falls below the dropout rate, so that it never enters the agenda of
that unit; other merges then lead to another segmentation. Every occurrence of a unit is
encoded by itself, so texts and places differ in how they cut the same word, and a repeated
run gives the same ids. With dropout 0 the ids are those of the library.

Characters that are no piece become byte pieces; so does U+2581 itself, which the library
cannot tell from a space. Decoding therefore gives back every text exactly.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; a
null document id is hashed like a value; other columns are carried through, and those with
the name of a result are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .pair_table import NONE, PairTable

MARK = "▁"
#: Units whose ids a task remembers without dropout.
REMEMBERED = 80_000
#: Characters above which a unit has a heap as its agenda, so that its time grows with n log n.
LONG_UNIT = 256
#: Units that are encoded together.
CHUNK = 8_000
#: Texts that are cut and encoded together.
TOGETHER = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_one(x: int) -> int:
    """``_mix`` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
    return x ^ x >> 31


class Pieces:
    """Piece table of a model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.known: dict[int, tuple[int, int]] | None = None
        self.byte = np.zeros(256, np.int64)
        self.decoded: list[bytes] = []
        usable: dict[str, int] = {}
        #: Cuts a text into units; a line break is one by itself if no piece holds it.
        self.unit = re.compile(r" +[^ ]*" if any("\n" in name for name in names) else r" +[^ \n]*|[^ \n]+|\n")
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.decoded.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.decoded.append(b"")
            else:
                usable[name] = i
                self.decoded.append(name.replace(MARK, " ").encode())
        self.char = np.full(0x110000, -1, np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for name, i in usable.items():
            if len(name) == 1:
                self.char[ord(name)] = i
            for cut in range(1, len(name)):
                left, right = usable.get(name[:cut]), usable.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.char[0x20], self.char[0x2581] = self.char[0x2581], -1
        # Ranks: equal scores tie, and the leftmost candidate wins.
        rank = np.unique([-model.get_score(i) for i in pairs.values()], return_inverse=True)[1]
        self.pairs = PairTable([a for a, _ in pairs], [b for _, b in pairs], rank, list(pairs.values()))

    def encode_units(self, units: list[str], dropout: float = 0.0, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (not empty) units, one behind the other, and where each starts and the last ends; ``keys`` has a hash for each unit, for dropout."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        last = np.cumsum(size)
        first = last - size
        n = len(points)
        symbol = self.char[points]
        # Linked symbols: the next live one (n: none), and the one before (-1: none).
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last - 1], before[first] = n, -1
        bound = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        if dropout:
            base = np.repeat(keys, size)
            end = np.repeat(last, size)
            offset = np.repeat(first, size)
        agenda, made = np.full(n, NONE << 32, np.int64) | np.arange(n), np.zeros(n, np.int32)

        def look(i: np.ndarray) -> None:
            """Enter the pairs of symbol i and the one after, unless their hash skips them."""
            j = after[i]
            rank, made[i] = self.pairs.look(symbol[i], symbol[j])
            if dropout:
                stop = np.minimum(after[j], end[j])
                span = (i - offset[i]) << 42 ^ (j - offset[i]) << 21 ^ (stop - offset[i])
                rank = np.where(_mix(base[i] ^ _mix(span.astype(np.uint64))) < bound, NONE, rank)
            agenda[i] = rank.astype(np.int64) << 32 | i

        short = size <= LONG_UNIT
        for u in np.nonzero(~short)[0].tolist():
            a, b = int(first[u]), int(last[u])
            symbol[a:b] = self._merge_long(symbol[a:b].tolist(), int(keys[u]) if dropout else 0, int(bound) if dropout else 0)
        live, starts, sizes = np.nonzero(np.repeat(short, size))[0], first[short], size[short]
        look(live[after[live] < n])
        while len(live):
            best = np.minimum.reduceat(agenda[live], np.cumsum(sizes) - sizes)
            open_ = best >> 32 != NONE
            if not open_.all():
                live, starts, sizes, best = live[np.repeat(open_, sizes)], starts[open_], sizes[open_], best[open_]
                if not len(live):
                    break
            i = best & 0xFFFFFFFF
            j = after[i]
            symbol[i], symbol[j] = made[i], -2
            agenda[i], agenda[j] = NONE << 32 | i, NONE << 32 | j
            after[i] = after[j]
            follows = i[after[i] < n]
            before[after[follows]] = follows
            look(follows)
            look(before[i][before[i] >= 0])
        keep = symbol != -2
        ids, where = symbol[keep].astype(np.int32), np.nonzero(keep)[0]
        cut = np.searchsorted(where, np.append(first, n))
        raw = np.nonzero(ids == -1)[0]
        if not len(raw):
            return ids, cut
        # Characters that are no piece become their bytes.
        coded = [chr(c).encode() if c != 0x20 else MARK.encode() for c in points[where[raw]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[raw] = list(map(len, coded))
        start = np.append(0, np.cumsum(times))
        out = np.repeat(ids, times)
        out[np.repeat(ids == -1, times)] = self.byte[np.frombuffer(b"".join(coded), np.uint8)]
        return out, start[cut]

    def _merge_long(self, symbol: list[int], key: int, bound: int) -> list[int]:
        """Symbols of one unit after all merges, -2 where one was absorbed: the same merges in the same order, from a heap."""
        if self.known is None:
            at = self.pairs._keys >= 0
            self.known = dict(zip(self.pairs._keys[at].tolist(), zip(self.pairs._rank[at].tolist(), self.pairs._made[at].tolist(), strict=True), strict=True))
        n, known = len(symbol), self.known
        after, before, stamp, made = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n, [0] * n
        heap: list[tuple[int, int, int]] = []

        def enter(i: int) -> None:
            stamp[i] += 1
            j = after[i]
            if j >= n or symbol[i] < 0 or symbol[j] < 0 or (found := known.get(symbol[i] << 20 | symbol[j])) is None:
                return
            if bound and _mix_one(key ^ _mix_one(i << 42 ^ j << 21 ^ after[j])) < bound:
                return
            made[i] = found[1]
            heapq.heappush(heap, (found[0], i, stamp[i]))

        for i in range(n - 1):
            enter(i)
        while heap:
            _, i, when = heapq.heappop(heap)
            if when != stamp[i]:
                continue
            j = after[i]
            symbol[i], symbol[j] = made[i], -2
            stamp[j] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            enter(i)
            if before[i] >= 0:
                enter(before[i])
        return symbol

    def decode(self, ids) -> str:
        return b"".join(map(self.decoded.__getitem__, ids)).decode()[1:]


def _encoded(pieces: Pieces, known: dict[str, bytes], texts: list, docs: np.ndarray, dropout: float) -> list[np.ndarray | None]:
    """Ids of each text; ``known`` holds the units that the task remembers, ``docs`` a hash of each text's document."""
    cut = [pieces.unit.findall(" " + text) if text else [] for text in texts]
    if dropout:
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        last = np.cumsum(size)
        place = np.arange(int(size.sum())) - np.repeat(last - size, size)
        keys = _mix(np.repeat(docs, size) ^ _mix(place.astype(np.uint64) + np.uint64(1)))
        units = list(chain.from_iterable(cut))
        ids, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(units), CHUNK):
            part, bounds = pieces.encode_units(units[a : a + CHUNK], dropout, keys[a : a + CHUNK])
            ids.append(part)
            count.append(np.diff(bounds))
        ends = np.append(0, np.cumsum(np.concatenate(count)))[np.append(0, last)]
        rows = np.split(np.concatenate(ids), ends[1:-1])
        return [None if text is None else row for text, row in zip(texts, rows, strict=True)]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set().union(*cut) - known.keys())
    for a in range(0, len(new), CHUNK):
        part, bounds = pieces.encode_units(new[a : a + CHUNK])
        # Bytes take a quarter of a list's memory.
        body, bounds = part.tobytes(), (4 * bounds).tolist()
        known.update(zip(new[a : a + CHUNK], (body[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
    return [None if text is None else np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for text, units in zip(texts, cut, strict=True)]


def _document(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text. ``model``: a path that every executor can read."""

    @F.pandas_udf("array<int>")
    @tidy
    def ids(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces, known = Pieces(model), {}
        for texts, hashes in batches:
            keys = hashes.to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(texts), TOGETHER):
                yield pd.Series(_encoded(pieces, known, texts[k : k + TOGETHER].tolist(), keys[k : k + TOGETHER], dropout), dtype=object)

    return docs.withColumn(ids_col, ids(F.col(text_col), _document(id_col, seed)))


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one Python process for each task, which then loads one piece table and sends the ids once."""

    @F.pandas_udf("ids array<int>, decoded string")
    @tidy
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pieces, known = Pieces(model), {}
        for texts, hashes in batches:
            keys = hashes.to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(texts), TOGETHER):
                ids = _encoded(pieces, known, texts[k : k + TOGETHER].tolist(), keys[k : k + TOGETHER], dropout)
                decoded = [None if row is None else pieces.decode(row.tolist()) for row in ids]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    coded = docs.withColumn("_coded", both(F.col(text_col), _document(id_col, seed)))
    return coded.withColumns({ids_col: F.col("_coded.ids"), decoded_col: F.col("_coded.decoded")}).drop("_coded")


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row of ids."""

    @F.pandas_udf("string")
    @tidy
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model)
        for rows in batches:
            yield pd.Series([None if r is None else pieces.decode(r.tolist()) for r in rows], dtype=object)

    return docs.withColumn(text_col, text(F.col(ids_col)))
