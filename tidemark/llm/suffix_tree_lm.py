"""A probabilistic suffix tree over words, its branches grown apart in the buckets of a shuffle.

Symbols are lower-cased words, and one end after each text. The root holds the counts of
all training symbols, smoothed by one. Below it hang contexts of one word to ``DEPTH``; the
end of the text before stands for the start of a text, and no context reaches over it. Every
context that training has ``LEAST`` times or more is a candidate, and every next symbol that
it has there ``LEAST`` times or more is stored; no share, rank or number bounds either, so
the tree grows with the input. A candidate is retained if its next-symbol counts diverge
from those of its suffix: their gain in log likelihood has to pay ``0.5 ln N`` for each
follower it stores. Next symbols of a context are discounted by ``DISCOUNT`` and share what
that leaves with the next shorter retained context, down to the root, so that every
context's distribution sums to one. A symbol is scored in the longest retained context that
ends before it.

Words. Texts become chunks of about ``TOGETHER`` symbols. A chunk asks for each distinct word
once, in packs by bucket of hashes; a bucket adds up what chunks have and numbers the words.

Branches. All contexts that end in the same word are one branch of the tree, and a branch
needs nothing of the others: places go with their words to the bucket of the word before
them, which counts the branch depth by depth, retains its contexts and answers with a sum of
log probabilities for each text. Places go in ``WAVES`` waves of buckets, so that the disk
holds one wave at a time; each place goes once.

Trunk. Of contexts that occur too often for one bucket (``HEAVY``), followers are counted
by rounds instead, each chunk asking for its distinct ones by hash, and branches begin one
word further. Sums over a trunk context pass through the driver; size bounds their number.

Words, and runs of words in the trunk, are known by their 64-bit hash.

Defined cases: a null or empty text is its end alone; without training rows every
probability is that of an unseen symbol, 1 (base and score are 0); repeated rows keep a row
each; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back, tidy
from .storage import discard, store, store_apart

#: The share of training symbols that a context needs besides ``LEAST`` occurrences: none.
MIN_SHARE = 0.0
LEAST = 2
DISCOUNT = 0.75
DEPTH = 4
#: Symbols of a chunk, of one text at least.
TOGETHER = 1_000_000
#: Bytes of text for each bucket of keys.
BUCKET_BYTES = 6_000_000
#: Contexts with more places than this (half of a bucket's), and than one for each ``HEAVY_BYTES`` of text, are of the trunk.
HEAVY = 500_000
HEAVY_BYTES = 25_000
WAVES = 4
#: Stands for the end of a text; no text has it, as words hold no white space.
END = b" "

TABLE = "chunk long, bucket int, data binary"
ANSWERS = "chunk long, bucket int, data binary, sums binary"
SUMS = "context long, n double, stored double, mass double, behind double, logs double"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def _dump(what: object) -> bytes:
    plain = pickle.dumps(what, protocol=5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _load(data: bytes) -> object:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _inverse(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def _retain(n: np.ndarray, stored: np.ndarray, mass: np.ndarray, behind: np.ndarray, logs: np.ndarray, total: int) -> np.ndarray:
    """The mass that each retained context leaves to its suffix; -1 for others.

    ``behind``: what the suffix gives the stored followers; ``logs``: sum of c ln(c / that).
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = logs - mass * np.log(np.maximum(n, 1))
        # The followers that are not stored are one more symbol of the divergence.
        other = n - mass
        gain = gain + np.where(other > 0, other * np.log(other / n / np.maximum(1 - behind, 1e-12)), 0)
        left = np.maximum(1 - (mass - DISCOUNT * stored) / n, 1e-12)
    return np.where((stored > 0) & (gain > 0.5 * np.log(max(total, 2)) * (stored + 1)), left, -1.0)


class Chunk:
    """Texts one behind the other, with an end before the first as before all others."""

    def __init__(self, number: int, ids: list, train: np.ndarray, wanted: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        self.number, self.ids, self.train, self.wanted, self.sizes = number, ids, train, wanted, sizes
        self.hashes, self.at = hashes, at  # distinct words, and which of them stands at each place
        # Of the distinct words: training's count, number (0: under LEAST), whether it is a context of the trunk.
        self.often = self.number_of = self.heavy = np.zeros(0, np.int64)
        self.space = 1  # of probabilities at the root
        # Depth of the trunk before each place, and probabilities of the places that have some.
        self.trunk, self.raised = np.zeros(len(at), np.uint8), np.zeros(0)
        # Places whose context of the next depth is of the trunk, and training's counts of these contexts.
        self.next_heavy = self.next_n = np.zeros(0, np.int64)

    @property
    def row(self) -> pd.DataFrame:
        return pd.DataFrame({"chunk": self.number, "bucket": pd.array([None], dtype="Int32"), "data": [_dump(vars(self))]})

    @classmethod
    def of(cls, data: bytes) -> Chunk:
        chunk = cls.__new__(cls)
        vars(chunk).update(_load(data))
        return chunk

    def packs(self, bucket: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
        """A row for each bucket with its part of each column."""
        order = np.argsort(_small(bucket), kind="stable")
        bucket = bucket[order]
        cut = np.nonzero(np.diff(bucket))[0] + 1
        columns = [c[order] for c in columns]
        ends = [0, *cut, len(bucket)] if len(bucket) else [0]
        parts = list(zip(ends[:-1], ends[1:], strict=True))
        return pd.DataFrame({
            "chunk": np.full(len(parts), self.number, np.int64), "bucket": pd.array([bucket[a] for a, _ in parts], dtype="Int32"),
            "data": [_dump([_small(c[a:b]) if c.dtype.kind == "u" else c[a:b] for c in columns]) for a, b in parts],
        })

    @staticmethod
    def answers(bucket: np.ndarray, packs: pd.DataFrame) -> list[np.ndarray]:
        """The columns of the answers, in the order of what was asked."""
        order = np.argsort(_small(bucket), kind="stable")
        got = [_load(x) for x in packs.sort_values("bucket")["data"]]
        out = []
        for parts in zip(*got, strict=True):
            column = np.concatenate(parts)
            back = np.zeros(len(order), column.dtype)
            back[order] = column
            out.append(back)
        return out

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text of each place but the first."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def before(self) -> np.ndarray:
        """How many symbols of its text each place has before it, its start included."""
        starts = np.cumsum(self.sizes) - self.sizes + 1
        return np.append(0, np.arange(1, len(self.at)) - np.repeat(starts, self.sizes) + 1)

    @property
    def p(self) -> np.ndarray:
        """Probability of each place's symbol, by the root and the trunk."""
        p = ((self.often + 1) / self.space)[self.at]
        p[self.trunk > 0] = self.raised
        return p

    # Words.

    def words_asked(self, buckets: int) -> pd.DataFrame:
        weight = np.repeat(self.train, self.sizes)
        mine, every = (np.bincount(self.at[1:], w, len(self.hashes)).astype(np.uint64) for w in (weight, None))
        return self.packs((self.hashes % np.uint64(buckets)).astype(np.int64), self.hashes, mine, every)

    def take_words(self, buckets: int, packs: pd.DataFrame, total: int, distinct: int) -> None:
        self.often, number, self.heavy = self.answers((self.hashes % np.uint64(buckets)).astype(np.int64), packs)
        self.number_of, self.space, self.hashes = _small(number), total + distinct + 1, None
        self.narrow = distinct * buckets < 2**32 or distinct < 2**31
        self.next_heavy = np.nonzero(self.heavy[self.at[:-1]])[0] + 1
        self.next_n = self.often[self.at[self.next_heavy - 1]]

    # Trunk: ``next_heavy`` are the places behind a trunk context of ``depth``.

    def run(self, place: np.ndarray, length: int) -> np.ndarray:
        """Key of the ``length`` words that end at each place: two numbers side by side where they fit, else a hash."""
        if length == 2 and self.narrow:
            return self.number_of[self.at[place - 1]].astype(np.uint64) << np.uint64(32) | self.number_of[self.at[place]]
        out = np.zeros(len(place), np.uint64)
        for k in range(length - 1, -1, -1):
            out = _longer(out, self.number_of[self.at[place - k]].astype(np.uint64))
        return out

    @property
    def known(self) -> np.ndarray:
        """Which of ``next_heavy`` have a symbol that may be stored."""
        return self.number_of[self.at[self.next_heavy]] > 0

    def trunk_asked(self, depth: int, buckets: int) -> tuple[np.ndarray, ...]:
        place = self.next_heavy[self.known]
        keys, first, of = np.unique(self.run(place, depth + 1), return_index=True, return_inverse=True)
        return place, first, of, keys, (_mix(keys * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)

    def trunk_packs(self, depth: int, buckets: int) -> pd.DataFrame:
        place, first, of, keys, bucket = self.trunk_asked(depth, buckets)
        weight = np.repeat(self.train, self.sizes)[place - 1]
        mine, every = (np.bincount(of, w, len(keys)).astype(np.uint64) for w in (weight, None))
        # Behind the root, the count takes less room than the probability.
        p = self.often[self.at[place[first]]].astype(np.uint64) if depth == 1 else self.p[place[first]]
        return self.packs(bucket, keys, mine, every, p, self.run(place[first] - 1, depth), self.next_n[self.known][first].astype(np.uint64))

    def take_trunk(self, depth: int, buckets: int, packs: pd.DataFrame, contexts: np.ndarray, n: np.ndarray, left: np.ndarray) -> None:
        """``contexts``: hashes of all trunk contexts of the depth, sorted, with their counts and what they leave."""
        p, here = self.p, self.next_heavy
        c, heavy = np.zeros(len(self.at)), np.zeros(len(self.at), bool)
        place, _, of, _, bucket = self.trunk_asked(depth, buckets)
        if len(place):
            count, often = self.answers(bucket, packs)
            c[place], heavy[place] = count[of], often[of]
        # A context whose followers are all unknown to training is not among them.
        own = self.run(here - 1, depth)
        which = np.minimum(np.searchsorted(contexts, own), max(len(contexts) - 1, 0))
        if len(contexts):
            found = (contexts[which] == own) & (left[which] >= 0)
            at, which = here[found], which[found]
            p[at] = np.where(c[at] >= LEAST, (c[at] - DISCOUNT) / n[which], 0.0) + left[which] * p[at]
        self.trunk[here] = depth
        self.raised = p[self.trunk > 0]
        after = np.nonzero(heavy[:-1])[0] + 1
        self.next_heavy = after[self.before[after] >= depth + 1]
        self.next_n = c[self.next_heavy - 1].astype(np.int64)

    # Branches.

    def branches(self, buckets: int, depth: int) -> tuple[np.ndarray, ...]:
        """Places whose contexts branches hold, the bucket of each, numbers of all words, and places' room before them."""
        number, before = self.number_of[self.at], self.before
        first = _mix(self.number_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        route = np.append(np.uint64(0), first[self.at[:-1]])
        sent = np.append(False, number[:-1] > 0)
        for k in range(1, int(self.trunk.max(initial=0)) + 1):
            place = np.nonzero(self.trunk >= k)[0]
            deep = place[(before[place] > k) & (k < depth)]
            sent[place] = False
            sent[deep] = number[deep - k - 1] > 0
            route[deep] = _longer(route[deep], number[deep - k - 1].astype(np.uint64))
        place = np.nonzero(sent)[0]
        return place, (route[place] % np.uint64(buckets)).astype(np.int64), number, before

    def branch_packs(self, buckets: int, depth: int, wave: int) -> pd.DataFrame:
        place, bucket, number, before = self.branches(buckets, depth)
        mine = np.nonzero(bucket % WAVES == wave)[0]
        place, bucket = place[mine], bucket[mine]
        contexts, there = [], np.ones(len(place), bool)
        for k in range(1, depth + 1):
            there &= before[place] >= k
            word = number[np.maximum(place - k, 0)] * there
            there &= word > 0
            contexts.append(word)
        text = self.text_of[place - 1]
        return self.packs(bucket, text.astype(np.uint64), self.train[text], self.trunk[place], self.p[place], number[place], *contexts)

    def plain_scores(self, buckets: int, depth: int) -> pd.DataFrame:
        """A row with what the chunk knows of its texts, without what branches have to add."""
        text = self.text_of
        by_text = lambda x: np.bincount(text, x, len(self.sizes))
        known, base = (self.often > 0)[self.at[1:]], np.log10((self.often + 1) / self.space)[self.at[1:]]
        full = np.log10(self.p)[1:]
        full[self.branches(buckets, depth)[0] - 1] = 0
        rows = self.ids, self.wanted, self.sizes, by_text(known).astype(np.int64), by_text(base), by_text(full)
        return pd.DataFrame({"chunk": self.number, "bucket": pd.array([None], dtype="Int32"), "data": [_dump(rows)]})


def _first_table(buckets: int):
    """Chunks of the texts, which ask for their words."""

    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}  # words of the chunk, by order of coming
        at: list[np.ndarray] = []
        ids, train, wanted = [], [], []
        held = made = 0

        def chunk() -> pd.DataFrame:
            nonlocal made
            sizes = np.fromiter(map(len, at), np.int64, len(at))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            one = Chunk((TaskContext.get().partitionId() << 32) + made, ids, np.array(train), np.array(wanted), sizes, hashes, np.concatenate([np.zeros(1, np.int32), *at]).astype(np.min_scalar_type(len(hashes))))
            made += 1
            return pd.concat([one.row, one.words_asked(buckets)])

        for batch in batches:
            for i, t, w, text in zip(batch["id"], batch["train"], batch["wanted"], batch["text"], strict=True):
                if not known:
                    known[END] = 0
                found = words(text)
                at.append(np.fromiter([*(known.setdefault(x, len(known)) for x in found), 0], np.int32, len(found) + 1))
                ids.append(i)
                train.append(t)
                wanted.append(w)
                held += len(found) + 1
                if held >= TOGETHER:
                    yield chunk()
                    known, at, ids, train, wanted, held = {}, [], [], [], [], 0
        if at:
            yield chunk()

    return rows


def _columns(packs: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all packs, and where packs end."""
    got = [_load(x) for x in packs["data"]]
    return [np.concatenate(parts) for parts in zip(*got, strict=True)], np.cumsum([len(x[0]) for x in got])


def _answers(packs: pd.DataFrame, ends: np.ndarray, columns: list[np.ndarray], sums: bytes | None = None) -> pd.DataFrame:
    parts = zip(*(np.split(c, ends[:-1]) for c in columns), strict=True)
    out = pd.DataFrame({"chunk": packs["chunk"], "bucket": packs["bucket"], "data": [_dump(list(x)) for x in parts], "sums": [sums, *[None] * (len(packs) - 1)]})
    give_back()
    return out


def _count_words(buckets: int, heavy: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of each word: training's count, its number, whether all texts have it too often for one bucket."""

    def count(packs: pd.DataFrame) -> pd.DataFrame:
        (keys, mine, every), ends = _columns(packs)
        keys, of = np.unique(keys, return_inverse=True)
        c, every = (np.bincount(of, x, len(keys)).astype(np.int64) for x in (mine, every))
        # Frequent words get small numbers, which take less room.
        rank = np.empty(len(c), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
        number = np.where(c >= LEAST, rank * buckets + int(packs["bucket"].iloc[0]) + 1, 0).astype(np.uint64)
        often = (c >= LEAST) & (every > heavy)
        return _answers(packs, ends, [c[of], number[of], often[of]], _dump((int(c.sum()), int((c > 0).sum()), int(often.sum()))))

    return count


def _count_trunk(heavy: int, depth: int, space: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of each follower of a trunk context: its count, whether with it the context stays in the trunk; sums by context."""

    def count(packs: pd.DataFrame) -> pd.DataFrame:
        (keys, mine, every, p, contexts, n), ends = _columns(packs)
        keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
        c, every = (np.bincount(of, x, len(keys)).astype(np.int64) for x in (mine, every))
        often, stored = (c >= LEAST) & (every > heavy), c >= LEAST
        contexts, at, which = np.unique(contexts[first], return_index=True, return_inverse=True)
        n, p = n[first][at], (p[first].astype(float) + 1) / space if depth == 1 else p[first]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(stored, c * np.log(c / p), 0)
        sums = [n.astype(float), *(np.bincount(which, x, len(contexts)) for x in (stored, c * stored, p * stored, logs))]
        return _answers(packs, ends, [c[of], often[of]], _dump((contexts.view(np.int64), *sums, int(often.sum()))))

    return count


def _grow(contexts: list[np.ndarray], symbol: np.ndarray, p: np.ndarray, trunk: np.ndarray, train: np.ndarray, total: int) -> np.ndarray:
    """Probability of each place's symbol by the branches of a bucket; words 0 are in no context and stored nowhere.

    ``p``: what the root and the trunk give, ``trunk``: the depth of that.
    """
    if max(int(x.max(initial=0)) for x in (symbol, *contexts)) >> 32:
        flat = np.unique(np.concatenate([np.zeros(1, np.uint64), symbol, *contexts]), return_inverse=True)[1][1:]
        symbol, *contexts = np.split(flat, len(contexts) + 1)
    weight, p = train.astype(float), p.copy()
    here = np.arange(len(p))  # places that have a context of the depth
    context, run = np.zeros(len(p), np.uint64), symbol.astype(np.uint64)  # known by numbers from 0, and from 1
    for d, word in enumerate(contexts, 1):
        there = word[here] > 0
        here, context, run = here[there], context[there], run[there]
        if not len(here):
            break
        word, given = word[here].astype(np.uint64), trunk[here] >= d
        context = _inverse(context << np.uint64(32) | word)
        n = np.bincount(context, weight[here])
        r = np.nonzero(run)[0]
        of = _inverse(run[r] << np.uint64(32) | word[r])
        c = np.bincount(of, weight[here[r]])
        one = np.zeros(len(c), np.int64)
        one[of] = r
        stored = (c >= LEAST) & ~given[one]
        k, at = c[stored], one[stored]
        before = p[here[at]]
        left = _retain(n, *(np.bincount(context[at], x, len(n)) for x in (np.ones(len(k)), k, before, k * np.log(k / before))), total)
        own = np.zeros(len(here))
        own[r] = np.where(stored, (c - DISCOUNT) / np.maximum(n[context[one]], 1), 0)[of]
        hit = np.nonzero(left[context] >= 0)[0]
        p[here[hit]] = own[hit] + left[context[hit]] * p[here[hit]]
        longer = np.zeros(len(here), np.uint64)
        longer[r] = np.where((c[of] >= LEAST) | given[r], of + np.uint64(1), 0)
        stay = (n[context] >= LEAST) | given
        here, context, run = here[stay], context[stay], longer[stay]
    return p


def _branch_sums(total: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each pack, the sums of log probabilities of its texts."""

    def sums(packs: pd.DataFrame) -> pd.DataFrame:
        (text, train, trunk, p, symbol, *contexts), ends = _columns(packs)
        logs = np.log10(_grow(contexts, symbol, p, trunk, train, total))
        data, a = [], 0
        for b in ends:
            # A pack has its places in the order of the texts.
            start = np.append(0, np.nonzero(np.diff(text[a:b]))[0] + 1)
            data.append(_dump((_small(text[a:b][start]), np.add.reduceat(logs[a:b], start))))
            a = b
        give_back()
        return pd.DataFrame({"chunk": packs["chunk"], "bucket": packs["bucket"], "data": data})

    return sums


def _added(packs: pd.DataFrame) -> np.ndarray:
    """The sums of a chunk's packs by text, as far as the last text that has some."""
    parts = [_load(x) for x in packs.sort_values("bucket")["data"]]
    texts, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.bincount(texts.astype(np.int64), sums)


def _wave_sums(wave: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The sums of a chunk's packs of a wave as one."""

    def sums(packs: pd.DataFrame) -> pd.DataFrame:
        added = _added(packs)
        return pd.DataFrame({"chunk": packs["chunk"].iloc[:1], "bucket": pd.array([wave], dtype="Int32"), "data": [_dump((np.arange(len(added)), added))]})

    return sums


def _scores(plain: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
    ids, wanted, sizes, known, base, score = _load(plain["data"].iloc[0])
    if len(packs):
        added = _added(packs)
        score[: len(added)] += added
    out = pd.DataFrame({"id": pd.Series(ids, dtype=object), "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})
    return out[wanted]


def _each(states: DataFrame, step: Callable[[Chunk], pd.DataFrame]) -> DataFrame:
    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                yield step(Chunk.of(data))

    return states.select("data").mapInPandas(rows, TABLE)


def _with_answers(rows: DataFrame, answers: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "data").groupBy("chunk")).applyInPandas(step, schema)


def _sum_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["sums"]:
            contexts, *sums, _ = _load(data)
            yield pd.DataFrame(dict(zip(["context", "n", "stored", "mass", "behind", "logs"], [contexts, *sums], strict=True)))


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["sums"]:
            *rest, heavy = _load(data)
            yield pd.DataFrame({"total": [rest[0] if len(rest) == 2 else 0], "distinct": [rest[1] if len(rest) == 2 else 0], "heavy": [heavy]})


def scored(docs: DataFrame, train: Column | DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row: ``id_col, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    ``train``: which rows of ``docs`` to learn from, or a table of other rows.
    """
    kind = docs.schema[id_col].dataType
    own = isinstance(train, Column)
    # Ids travel as text, so that nulls among them leave the others as they are.
    texts = docs.select(F.col(id_col).cast("string").alias("id"), (F.coalesce(train, F.lit(False)) if own else F.lit(False)).alias("train"), F.lit(True).alias("wanted"), F.col(text_col).alias("text"))
    if not own:
        texts = texts.unionByName(train.select(F.lit(None).cast("string").alias("id"), F.lit(True).alias("train"), F.lit(False).alias("wanted"), F.col(text_col).alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, heavy = 1 + size // BUCKET_BYTES, max(HEAVY, size // HEAVY_BYTES)

    def answered(packs: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame]) -> tuple[DataFrame, tuple[int, int, int]]:
        answers = store(packs.groupBy("bucket").applyInPandas(answer, ANSWERS), "answers")
        sums = answers.where("sums IS NOT NULL").select("sums").mapInPandas(_totals, "total long, distinct long, heavy long")
        return answers, sums.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in sums.columns)).first()

    def following(states: DataFrame, answers: DataFrame, step: Callable[[Chunk, pd.DataFrame], None]) -> DataFrame:
        def rows(own: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
            chunk = Chunk.of(own["data"].iloc[0])
            step(chunk, packs)
            give_back()
            return chunk.row

        new = store(_with_answers(states, answers, rows, TABLE), "chunks")
        discard(states)
        discard(answers)
        return new

    packs, states = store_apart(texts.mapInPandas(_first_table(buckets), TABLE), F.col("bucket").isNotNull(), "chunks")
    answers, (total, distinct, trunk) = answered(packs, _count_words(buckets, heavy))
    discard(packs)
    states = following(states, answers, lambda chunk, packs: chunk.take_words(buckets, packs, total, distinct))
    d = 0
    while trunk and d < depth:
        d += 1
        answers, (_, _, trunk) = answered(_each(states, lambda chunk, d=d: chunk.trunk_packs(d, buckets)), _count_trunk(heavy, d, total + distinct + 1))
        sums = answers.where("sums IS NOT NULL").select("sums").mapInPandas(_sum_rows, SUMS)
        sums = sums.groupBy("context").agg(F.max("n").alias("n"), *(F.sum(x).alias(x) for x in sums.columns[2:])).toPandas()
        contexts = sums.pop("context").to_numpy(np.int64).view(np.uint64)
        order = np.argsort(contexts)
        table = contexts[order], sums["n"].to_numpy(float)[order], _retain(*(sums[x].to_numpy(float)[order] for x in sums), total)
        states = following(states, answers, lambda chunk, packs, d=d, table=table: chunk.take_trunk(d, buckets, packs, *table))

    found = None
    for wave in range(min(WAVES, buckets)):
        packs = _each(states, lambda chunk, wave=wave: chunk.branch_packs(buckets, depth, wave))
        sums = packs.groupBy("bucket").applyInPandas(_branch_sums(total), TABLE)
        sums = store(sums.groupBy("chunk").applyInPandas(_wave_sums(wave), TABLE), "sums")
        found = sums if found is None else found.unionByName(sums)
    plain = store(_each(states, lambda chunk: chunk.plain_scores(buckets, depth)), "texts")
    discard(states)
    out = _with_answers(plain, found, _scores, "id string, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
