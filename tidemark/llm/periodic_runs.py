"""Runs of repeated words in each text, by the branching tandem test on an enhanced suffix array.

A run is a maximal stretch of words of which every one equals the word its period before.
Where a run of period q ends, the square in its last 2q words cannot be carried on by one
word: the suffixes q apart that start it share exactly q words, so they lie in one LCP
interval of depth q, in different children. For every boundary of an interval the suffixes
of the smaller side are taken, and the inverse suffix array tells whether the suffix that
stands the depth after (or before) lies on the other side: O(n log n) lookups find each such
square. A square is rotated to the left as long as the word that comes in equals the one that
goes out, which gives the run; squares of one stretch merge into the run of the smallest period.

Intervals are ranges of the array (nearest smaller LCP values on both sides), no nodes are
made. The array comes from prefix doubling over many texts at once, where each step sorts
only what still has an equal; the ranks of the steps also answer how far two places agree,
to the right and to the left. Texts in which no ``least - least // times`` words occur twice
have no run and end there; the others go all the way.

Each text is handled alone and whole, so nothing is shuffled, and a batch holds ``TOGETHER``
words or one text, with four bytes for each word and doubling step.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a word
is what stands between spaces, tabs and line ends (codes 9 to 13); equal rows have equal
results; other columns are carried through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .memory import give_back

#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 24, 3
#: Words that are handled at once, and suffixes looked up at once.
TOGETHER, LOOKUPS = 200_000, 1_000_000


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``key``, and for each place in it the first place of an equal key."""
    order = np.argsort(key)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    return order, np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))


def _repeated(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Members of groups of two and more."""
    size = np.bincount(start, minlength=len(start))
    return order[size[start] > 1]


def _ranks(key: np.ndarray, end: np.ndarray, deep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, ... words (equal: those words are), until no two are equal.

    From the ``deep``-th on, texts without equal ranks are left out of what is returned: the
    mask of the places that stay, in which the ranks count.
    """
    n = len(key)
    order, start = _groups(key)
    rank = np.empty(n, np.int32)
    rank[order] = start
    levels, live = [rank], _repeated(order, start)
    keep = None
    while True:
        if len(levels) == deep + 1:
            keep = np.zeros(n + 1, np.int64)
            text = end[live]
            keep[np.unique(text)] = 1
            keep = keep[end].astype(bool)
        if not len(live):
            break
        step = 1 << (len(levels) - 1)
        after = live + step
        inside = after < end[live]
        own = rank[live].astype(np.int64)
        second = np.where(inside, rank[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
        order, start = _groups(own * (n + 1) + second)
        own = own[order]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(own) != 0]), np.arange(len(own)), 0))
        new = rank.copy()
        new[live[order]] = own + start - group
        rank = new
        levels.append(rank)
        live = live[_repeated(order, start)]
    if keep is None:
        keep = np.zeros(n, bool)
    return levels, keep


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, bound: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on (``back``: before them), with ``b`` behind ``a`` and ``bound`` the text's end (start)."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if back:
            x, y = a - length - step, b - length - step
            ok = x >= bound
        else:
            x, y = a + length, b + length
            ok = np.maximum(x, y) + step <= bound
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        length += np.where(ok & (levels[k][x] == levels[k][y]), step, 0)
    return length


def _smaller(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before with a smaller value (not ``strict``: or an equal one); place 0 has the smallest."""
    at = np.maximum(np.arange(len(values)) - 1, 0)
    todo = np.arange(1, len(values))
    while True:
        there = values[at[todo]]
        todo = todo[(there >= values[todo]) if strict else (there > values[todo])]
        todo = todo[at[todo] > 0]
        if not len(todo):
            return at
        # What lies between a place and where it points is not smaller than it.
        at[todo] = at[at[todo]]


def _squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, begin: np.ndarray, end: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares whose halves agree on exactly the period's words."""
    n = len(sa)
    low = _smaller(lcp, True)
    # The next smaller or equal one is the one before in reversed order.
    high = n - _smaller(np.concatenate([[-3], lcp[::-1]]), False)[:0:-1]
    at = np.nonzero((lcp > 0) & (times * lcp <= end[sa] - begin[sa]))[0]
    left, right = at - low[at], high[at] - at
    first = np.where(left <= right, low[at], at)
    size = np.minimum(left, right)
    other_low, other_high = np.where(left <= right, at, low[at]), np.where(left <= right, high[at], at)
    total = np.cumsum(size)
    parts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(LOOKUPS, int(size.sum()), LOOKUPS)), [len(at)]]))
    starts, periods = [], []
    for x, y in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
        of = np.repeat(np.arange(x, y), size[x:y])
        i = sa[np.arange(len(of)) - (total[of] - size[of] - (total[x] - size[x])) + first[of]]
        depth = lcp[at[of]]
        for back in (False, True):
            j = i - depth if back else i + depth
            ok = (j >= begin[i]) if back else (j < end[i])
            r = isa[np.where(ok, j, 0)]
            hit = np.nonzero(ok & (other_low[of] <= r) & (r < other_high[of]))[0]
            starts.append((j if back else i)[hit])
            periods.append(depth[hit])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text (an array of word numbers) an array of rows start, length, period, by start and period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    found = [np.zeros((0, 3), np.int64)] * len(texts)
    n = int(sizes.sum())
    if not n:
        return found
    word = np.concatenate(texts).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    # The suffixes a period apart where a run starts share this many words at least.
    deep = int(np.log2(max(1, least - least // times)))
    levels, keep = _ranks(text * (int(word.max()) + 1) + word, ends[text], deep)
    if not keep.any():
        return found
    # Places and ranks of one text fill the same range, so both move down alike.
    shift = np.cumsum(~keep)[keep]
    levels = [(x[keep] - shift).astype(np.int32) for x in levels]
    text = text[keep]
    begin = np.searchsorted(text, text)
    end = np.searchsorted(text, text, side="right")
    isa = levels[-1].astype(np.int64)
    sa = np.empty_like(isa)
    sa[isa] = np.arange(len(isa))
    lcp = np.full(len(sa), -1, np.int64)
    inner = np.nonzero(text[1:] == text[:-1])[0] + 1
    lcp[inner] = _agree(levels, sa[inner - 1], sa[inner], end[sa[inner]])
    lcp[0] = -2
    start, period = _squares(sa, isa, lcp, begin, end, times)
    back = _agree(levels, start, start + period, begin[start], back=True)
    length = back + 2 * period
    start = start - back
    # Of one stretch, the smallest period.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    new &= length >= np.maximum(least, times * period)
    start, length, period = start[new], length[new], period[new]
    if not len(start):
        return found
    order = np.lexsort((period, start))
    rows = np.stack([start - begin[start], length, period], axis=1)[order]
    of = text[start[order]]
    cut = np.searchsorted(of, np.unique(of))
    for k, part in zip(np.unique(of).tolist(), np.split(rows, cut[1:]), strict=True):
        found[k] = part
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains behind its first period, with one space between."""
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.nonzero(np.cumsum(gone)[:-1] == 0)[0].tolist()]
    return b" ".join(words).decode()


def runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct ``n_words, start, length, period, collapsed`` of a text: its runs as three arrays in the order of start and period."""

    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            held: list[list[bytes]] = []
            numbers: list[np.ndarray] = []
            total = 0
            known: dict[bytes, int] = {}

            def flush() -> None:
                for words, found in zip(held, find_runs(numbers, least, times), strict=True):
                    out.append((len(words), *[found[:, c].tolist() for c in range(3)], collapsed(words, found)))
                held.clear()
                numbers.clear()
                known.clear()

            for value in batch:
                words = (value or "").encode().split()
                if held and total + len(words) > TOGETHER:
                    flush()
                    total = 0
                total += len(words)
                held.append(words)
                numbers.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)))
            flush()
            yield pd.DataFrame(out, columns=["n_words", "start", "length", "period", "collapsed"])
        give_back()

    return search(text)
