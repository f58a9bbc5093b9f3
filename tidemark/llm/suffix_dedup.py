"""Exact removal of byte strings that an earlier document has, by suffix arrays.

A window of ``length`` bytes goes if the same bytes stand anywhere in a document with a
smaller id. Suffix arrays find the equal windows; what follows makes them small and many:

0. Texts. Equal texts are grouped by their bytes; the smallest id keeps one, all other copies
   lose every byte. Distinct texts are numbered in the order of their smallest ids.
1. Anchors. Every window has a K-byte gram with the smallest hash (the leftmost of equal ones). Equal
   windows have equal anchors at equal offsets, so only windows whose anchor hash stands in
   two documents can match. A gram that several documents of one batch share is known to be
   shared and crosses the shuffle once, so a passage in a third of all documents loads no task.
2. Contexts. For each shared anchor, a document contributes the bytes of the windows that
   the anchor owns (at most 2 x length - K bytes). Equal contexts in one batch are sent
   once, with their smallest id; the other ids are decided by that already. A context whose
   bytes on both sides of the anchor no other context has is out.
3. Suffix arrays. The distinct contexts of an anchor are joined to one string, sorted by
   linear grouping (``suffix_array``), and windows equal over ``length`` bytes stand next to
   each other there; the smallest id of such a run decides. An anchor with one context only
   has nothing to sort. Contexts of anchors that are more frequent than ``HOT`` are split
   into their windows, and so is an anchor's string with over ``SPLIT`` contexts: each
   distinct window is then a string of its own.
4. The covered byte ranges of each document are cut from its text.

Defined cases: a null text is empty; texts shorter than ``length`` bytes lose nothing; rows
that repeat (equal id and text) are one document; rows with an equal id and other texts are
documents of their own, one after the other by hash, and so are rows without an id, which
come last; other columns are carried through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back, tidy
from .storage import discard, store
from .suffix_array import suffix_arrays

LENGTH = 50
K = 16
#: Anchors in more places than this, and than a HOT_KEYS-th of all places, are split by window.
HOT = 50_000
HOT_KEYS = 100_000
#: Distinct contexts up to which an anchor's contexts are sorted as one string.
SPLIT = 8
#: Bytes of text whose anchors are found together.
CHUNK = 128_000
PLACE_BITS = (1 << 24) - 1
#: Bytes of a long text whose anchors are found at a time.
PIECE = 4_000_000
#: Characters of text, and anchor places, of which a task holds the rows at a time.
PART, PLACES = 6_000_000, 120_000
#: Rows that a task decides together; the more, the longer the arrays in each step.
TOGETHER = 40_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (16 to 24) at every position."""
    x = data.astype(np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    m = len(data) - k + 1
    h = _mix(_mix(eight[:m]) ^ eight[8 : 8 + m])
    return _mix(h ^ eight[k - 8 : k - 8 + m]) if k > 16 else h


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: number of its text, hash, position, first and last window that it owns."""
    use = np.array([t for t, text in enumerate(texts) if len(text) >= length], np.int64)
    if not len(use):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    data = np.frombuffer(b"".join(texts[t] for t in use), np.uint8)
    ends = np.cumsum([len(texts[t]) for t in use])
    h = _grams(data, k)
    # The smallest upper hash bits win, then the leftmost place, which the lower bits hold.
    mask = np.uint64(PLACE_BITS)
    order = (h & ~mask) | (np.arange(len(h), dtype=np.uint64) & mask)
    low = (_slide(order, length - k + 1, np.minimum) & mask).astype(np.int64)
    # Windows over the end of a text are none.
    over = (ends[:-1, None] - np.arange(1, length)[None, :]).ravel()
    low[over[(over >= 0) & (over < len(low))]] = -1
    # The place that wins only moves to the right, so that each owns a run of windows.
    first = np.nonzero(np.concatenate([[True], low[1:] != low[:-1]]))[0]
    last = np.append(first[1:], len(low)) - 1
    own = low[first] >= 0
    first, last = first[own], last[own]
    at = first + ((low[first] - first) & PLACE_BITS)
    own = h[at]
    text = np.searchsorted(ends, at, "right")
    begin = np.concatenate([[0], ends[:-1]])[text]
    return use[text], own, at - begin, first - begin, last - begin


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, offset, bytes) in runs of about ``CHUNK`` bytes; long texts come in pieces that share their windows' bytes."""
    held, run = 0, []
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            run.append((t, at, text[at : at + PIECE + length - 1]))
            held += len(run[-1][2])
            if held > CHUNK:
                yield run
                held, run = 0, []
    if run:
        yield run


def _parts(batch: pd.DataFrame, weight: list[int], most: int) -> Iterator[pd.DataFrame]:
    """Runs of rows of a batch, each of about ``most`` of a row's weight."""
    first, held = 0, 0
    for k, w in enumerate(weight):
        held += w
        if held > most:
            yield batch.iloc[first : k + 1]
            first, held = k + 1, 0
    if first < len(batch):
        yield batch.iloc[first:]


def _place_rows(length: int, k: int):
    """Anchor places of a part of a batch. kind 1: known to be shared; 2: tells other parts, with the number of places; 0: not known yet."""

    @tidy
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, list(map(len, batch["text"])), PART):
                yield found(part)

    def found(batch: pd.DataFrame) -> pd.DataFrame:
        ids, texts = batch["n"].to_numpy(np.int64), [t.encode() for t in batch["text"]]
        rows = [(np.zeros(0, np.int64),) * 3]
        for run in _pieces(texts, length):
            of, offset = np.array([t for t, _, _ in run]), np.array([at for _, at, _ in run])
            piece, h, at, first, last = anchors([data for _, _, data in run], length, k)
            rows.append((h.view(np.int64), ids[of[piece]], at + offset[piece] << 16 | (at - first) << 8 | (at - last)))
        h, doc, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((doc, h))
        h, doc, place = h[order], doc[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        heads = np.nonzero(new)[0]
        size = np.diff(np.append(heads, len(h)))
        shared = doc[heads] < doc[heads + size - 1]
        beacon = heads[shared]
        known = np.repeat(shared, size)
        return pd.DataFrame({
            "route": np.concatenate([np.where(known, doc * -7046029254386353131, h), h[beacon]]),
            "kind": np.concatenate([known.astype(np.int32), np.full(len(beacon), 2, np.int32)]),
            "h": np.concatenate([h, h[beacon]]),
            "doc": np.concatenate([doc, doc[beacon]]),
            "place": np.concatenate([place, size[shared]]),
        })

    return places


def shared_places(texts: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``(kind, doc, h, place)`` of all anchors of ``texts`` (n, text) whose hash stands in two texts or more; kind 2 counts the places of a hash."""
    from pyspark.sql import Window

    rows = texts.mapInPandas(_place_rows(length, k), "route long, kind int, h long, doc long, place long")
    rows = rows.withColumn("known", F.col("kind") == 1)
    one = Window.partitionBy("known", "route")
    rows = rows.withColumn("lo", F.min("doc").over(one)).withColumn("hi", F.max("doc").over(one))
    return rows.where("kind > 0 or lo < hi").select("kind", "doc", "h", "place")


def _merged_ranges(rows: np.ndarray) -> np.ndarray:
    """(doc, start, size) rows with those joined that touch or overlap."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    out: list[list[int]] = []
    for doc, start, size in rows.tolist():
        if out and out[-1][0] == doc and start <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], start + size - out[-1][1])
        else:
            out.append([doc, start, size])
    return np.array(out, np.int64)


class _Least:
    """Smallest number of each key (anchor, bytes, offset) of a batch; other numbers that bring an equal key are decided."""

    def __init__(self) -> None:
        self.least: dict[tuple[int, bytes, int], tuple[int, int]] = {}
        self.gone: list[tuple[int, int, int]] = []
        self.again: list[tuple[int, bytes, int, int, int]] = []

    def take(self, key: tuple[int, bytes, int], doc: int, start: int) -> None:
        was = self.least.setdefault(key, (doc, start))
        if doc > was[0]:
            self.gone.append((doc, start, len(key[1])))
        elif doc < was[0]:
            self.gone.append((*was, len(key[1])))
            self.least[key] = (doc, start)
        elif start != was[1]:  # the same bytes again in one document
            self.again.append((*key, doc, start))

    def first(self) -> Iterator[tuple[int, bytes, int, int, int]]:
        for key, (doc, start) in self.least.items():
            yield *key, doc, start
        yield from self.again


def _context_rows(length: int, k: int):
    """Contexts of shared anchors, ``at`` the anchor's offset. Rows with ``size`` and no ``bytes`` are ranges to remove."""

    @tidy
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, list(map(len, batch["place"])), PLACES):
                yield from found(part)

    def found(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, frequent = _Least(), set()
        take = found.take
        for doc, text, places in zip(batch["doc"].tolist(), batch["text"], batch["place"], strict=True):
            data = text.encode()
            hots, places = places & 1, places >> 1
            at = places >> 16
            for hot, p, a, b in zip(hots.tolist(), at.tolist(), (at - (places >> 8 & 255)).tolist(), (at - (places & 255) + length).tolist(), strict=True):
                h = xxhash.xxh64_intdigest(data[p : p + k]) - 2**63
                if hot:
                    frequent.add(h)
                take((h, data[a:b], p - a), doc, a)
        split, keep = _Least(), []
        for row in found.first():
            h, body, _, doc, start = row
            if h not in frequent:
                keep.append(row)
                continue
            for w in range(len(body) - length + 1):
                window = body[w : w + length]
                key = int.from_bytes(hashlib.blake2b(window, digest_size=8, salt=b"window").digest(), "little", signed=True)
                split.take((key, window, -1), doc, start + w)
        for rows in (keep, split.first()):
            rows = list(rows)
            for n in range(0, len(rows), 50_000):
                h, body, at, doc, start = zip(*rows[n : n + 50_000], strict=True)
                yield pd.DataFrame({"route": h, "bytes": body, "at": at, "doc": doc, "start": start, "size": [len(b) for b in body]})
        gone = _merged_ranges(np.array(found.gone + split.gone, np.int64).reshape(-1, 3))
        yield pd.DataFrame({"route": gone[:, 0] * 31, "bytes": None, "at": -1, "doc": gone[:, 0], "start": gone[:, 1], "size": gone[:, 2]})

    return contexts


def _alone(texts: list[bytes], of: np.ndarray, at: np.ndarray, length: int, k: int) -> np.ndarray:
    """Contexts that cannot match another of their anchor: a window has (length - k) / 2 bytes
    left or right of its anchor at least, and no other context has those of this one."""
    side = (length - k + 1) // 2
    out = np.ones(len(texts), bool)
    for bytes_of in (lambda t, p: t[p - side : p] if p >= side else None, lambda t, p: t[p + k : p + k + side] if p + k + side <= len(t) else None):
        code = pd.factorize(np.array([bytes_of(t, p) for t, p in zip(texts, at.tolist(), strict=True)], object))[0]
        _, which, count = np.unique(of * (len(code) + 1) + code, return_inverse=True, return_counts=True)
        out &= (code < 0) | (count[which] == 1)
    return out


def _decide(rows: pd.DataFrame, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges (doc, start, size) that go, of rows with whole groups of ``route``, sorted by it."""
    doc, start, size, at = (rows[c].to_numpy(np.int64) for c in ("doc", "start", "size", "at"))
    known = rows["bytes"].isna().to_numpy()
    yield doc[known], start[known], size[known]
    rows = rows[~known]
    doc, start, size, at = doc[~known], start[~known], size[~known], at[~known]
    if not len(rows):
        return
    route = rows["route"].to_numpy()
    group = np.cumsum(np.concatenate([[True], route[1:] != route[:-1]])) - 1
    code = pd.factorize(rows["bytes"])[0]
    _, where, context = np.unique(group * (len(code) + 1) + code, return_index=True, return_inverse=True)
    texts, of = rows["bytes"].to_numpy()[where], group[where]
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, context, doc)
    later = doc > least[context]
    yield doc[later], start[later], size[later]
    # What is left are the first texts of each distinct context.
    low, high = np.full(len(texts), length), np.full(len(texts), -1)
    np.minimum.at(low, context, at)
    np.maximum.at(high, context, at)
    open_ = np.nonzero(np.bincount(of, minlength=group[-1] + 1)[of] > 1)[0]
    alone = _alone(texts[open_].tolist(), of[open_], low[open_], length, k)
    # Where a context has its anchor in two places, it has sides of both: all of that anchor's are sorted.
    twice = np.bincount(of[low < high], minlength=group[-1] + 1)
    open_ = open_[~alone | (twice[of[open_]] > 0)]
    many = np.bincount(of[open_], minlength=group[-1] + 1)[of[open_]]
    hits = []
    if len(small := open_[(many > 1) & (many <= SPLIT)]):
        hits.append(_sorted_hits(np.split(small, np.nonzero(np.diff(of[small]))[0] + 1), texts, least, length))
    if len(large := open_[many > SPLIT]):
        hits.append(_single_hits(large, of[large], texts, least, length))
    if not hits:
        return
    hit_context, hit_offset = (np.concatenate(x) for x in zip(*hits, strict=True))
    # Join to the rows of each context's smallest number.
    first = np.nonzero(~later)[0]
    first = first[np.argsort(context[first], kind="stable")]
    low = np.searchsorted(context[first], hit_context, "left")
    count = np.searchsorted(context[first], hit_context, "right") - low
    each = np.repeat(np.arange(len(hit_context)), count)
    row = first[low[each] + np.arange(len(each)) - (np.cumsum(count) - count)[each]]
    yield doc[row], start[row] + hit_offset[each], np.full(len(row), length)


def _words_at(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The bytes ``at`` to ``at + length`` as 64-bit words."""
    word = np.lib.stride_tricks.sliding_window_view(data, 8)
    for step in [*range(0, length - 8, 8), length - 8]:
        yield np.ascontiguousarray(word[at + step]).view("<u8").ravel()


def _sorted_hits(strings, texts, least, length):
    """(context, offset) of the windows that a context with a smaller number has too."""
    pieces = np.concatenate(strings)
    last = np.zeros(len(pieces), bool)
    last[np.cumsum(list(map(len, strings))) - 1] = True
    # Each context is followed by a symbol below all bytes, each string by the smallest one.
    size = np.array([len(texts[c]) for c in pieces.tolist()])
    data = np.frombuffer(b"".join(texts[c] + b"\0\0"[not end :] for c, end in zip(pieces.tolist(), last.tolist(), strict=True)), np.uint8)
    slot = size + 1 + last
    begin = np.cumsum(slot) - slot
    ends = (begin + slot)[last]
    text = data.astype(np.int32) + 2
    text[begin + size], text[ends - 1] = 1, 0
    array = suffix_arrays(text, np.append(0, ends[:-1]), ends)
    owner = np.repeat(np.arange(len(pieces)), slot)
    array = array[(begin + size)[owner[array]] - array >= length]
    if len(array) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.cumsum(last) - last
    same = string[owner[array[1:]]] == string[owner[array[:-1]]]
    for word in _words_at(data, array, length):
        same &= word[1:] == word[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    own = least[pieces[owner[array]]]
    low = np.minimum.reduceat(own, np.nonzero(np.concatenate([[True], ~same]))[0])[run]
    hit = array[low < own]
    return pieces[owner[hit]], hit - begin[owner[hit]]


def _single_hits(large, of, texts, least, length):
    """The same for contexts whose every window is a string of its own: equal strings are
    found by a hash, and a hit is compared with the string of the smallest id."""
    size = np.array([len(texts[c]) for c in large], np.int64)
    data = np.frombuffer(b"".join(texts[c] for c in large), np.uint8)
    count = size - length + 1
    context = np.repeat(np.arange(len(large)), count)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[context] + offset
    h = of[context].astype(np.uint64)
    for word in _words_at(data, at, length):
        h = _mix(h ^ word)
    low = least[large][context]
    order = np.lexsort((low, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = order[np.nonzero(new)[0][np.cumsum(new) - 1]]
    hit = low[order] > low[first]
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    mine, other = order[hit], first[hit]
    same = np.ones(len(mine), bool)
    for k in range(0, len(mine), 20_000):
        same[k : k + 20_000] = (window[at[mine[k : k + 20_000]]] == window[at[other[k : k + 20_000]]]).all(axis=1)
    return large[context[mine[same]]], offset[mine[same]]


def _range_rows(length: int, k: int):
    @tidy
    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by route; the last route of a batch waits for the next one."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TOGETHER:
                continue
            if held[0]["route"].iloc[0] == batch["route"].iloc[-1]:
                continue  # one route so far: it is joined once, when it ends
            rows = pd.concat(held, ignore_index=True)
            route = rows["route"].to_numpy()
            cut = int(np.searchsorted(route, route[-1]))
            held = [rows.iloc[cut:]]
            yield from frames(rows.iloc[:cut])
        if held:
            yield from frames(pd.concat(held, ignore_index=True))

    def frames(rows):
        for doc, start, size in _decide(rows.reset_index(drop=True), length, k):
            if len(doc):
                yield pd.DataFrame({"doc": doc, "start": start, "size": size})

    return ranges


def _keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: two 64-bit hashes with seeds of their own."""
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(n, first, last, t, u, text)``: the distinct texts of ``length`` bytes or more, numbered in the order of their smallest id.

    Whole copies meet here by their bytes: all but those with the ``first`` id go. Ids may be
    of any type with an order; null comes last.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    texts = plain.groupBy("text").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    texts = texts.select("first", "last", *_keys(F.col("text")), "text").orderBy("first", "t", "u")
    return texts.withColumn("n", F.monotonically_increasing_id())


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """``(t, u, first, last, s)`` of the distinct texts that lose bytes or have copies: ``s`` are the byte ranges (start, end) that the one with the first id loses."""
    texts = store(numbered(docs, id_col, text_col, length), "suffix-texts")
    shared = store(shared_places(texts.select("n", "text"), length, k), "shared-anchors")
    # At most HOT_KEYS hashes are so frequent, which bounds what is broadcast.
    counts = shared.where("kind = 2").groupBy("h").agg(F.sum("place").alias("count"))
    limit = max(HOT, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_KEYS)
    hot = counts.where(F.col("count") > limit).select("h", F.lit(True).alias("hot"))
    marked = shared.where("kind < 2").join(F.broadcast(hot), "h", "left").select("doc", (2 * F.col("place") + F.when(F.col("hot"), 1).otherwise(0)).alias("place"))
    by_doc = store(marked.groupBy("doc").agg(F.collect_list("place").alias("place")), "anchor-places")
    discard(shared)
    found = texts.select(F.col("n").alias("doc"), "text").join(by_doc, "doc").select("doc", "text", "place")
    found = found.mapInPandas(_context_rows(length, k), "route long, bytes binary, at int, doc long, start long, size long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "route").sortWithinPartitions("route")
    gone = found.mapInPandas(_range_rows(length, k), "doc long, start long, size long")
    spans = gone.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("s"))
    known = texts.select("n", "t", "u", "first", "last").join(spans, F.col("n") == F.col("doc"), "left")
    out = store(known.where(F.col("s").isNotNull() | (F.col("first") < F.col("last"))).select("t", "u", "first", "last", "s"), "cuts")
    discard(by_doc)
    discard(texts)
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint ranges of sorted (start, end) ranges."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All columns of ``docs``, and ``_kept`` (the bytes that stay), ``_removed`` and ``_spans`` (counts).

    Columns of ``docs`` with these names are replaced.
    """

    @F.pandas_udf("kept binary, removed long, spans long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, ranges in zip(texts, spans, strict=True):
                data = (text or "").encode()
                gone = merged((r["start"], r["end"]) for r in ranges) if ranges is not None else []
                kept, last = [], 0
                for a, b in gone:
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                rows.append((b"".join(kept), sum(b - a for a, b in gone), len(gone)))
            yield pd.DataFrame(rows, columns=["kept", "removed", "spans"])
        give_back()

    # One column holds the row, so that no name inside can meet one outside.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(F.col(text_col)))
    joined = rows.join(cuts(docs, id_col, text_col, length), ["t", "u"], "left")
    own = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(F.col("row")[text_col]).cast("long").alias("end")))
    joined = joined.select("row", cut(F.col("row")[text_col], F.when(own > F.col("first"), whole).otherwise(F.col("s"))).alias("cut"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("_kept", "_removed", "_spans")]
    return joined.select(*others, F.col("cut.kept").alias("_kept"), F.col("cut.removed").alias("_removed"), F.col("cut.spans").alias("_spans"))


def whole_characters(kept: Column) -> Column:
    """Kept bytes as text; what a cut left of a character that it went through is dropped."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else r.decode(errors="ignore") for r in rows], dtype=object)

    return text(kept)
