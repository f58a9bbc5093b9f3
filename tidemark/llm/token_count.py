"""Token counts of a word-level BPE vocabulary by rank-synchronous array merging.

Each batch of texts is normalised and cut into pre-tokens. The distinct ones that the task
has not met before become one ragged numpy array of symbols. In every round each sequence
finds its lowest-ranked pair and merges all places of it at once; sequences without a
mergeable pair leave, and what survives is counted.

The vocabulary file names NFC, white-space folding, lower case, the pre-token pattern, byte
symbols and the end-of-word suffix; its special strings inside a text are one token each.

Defined cases: a null text is empty and has no tokens; repeated rows keep a row each;
other columns are carried through, and one with the name of the result is replaced. A
pre-token of n bytes takes up to n rounds over what is left of it, so one without a space
or other cut costs the square of its length at worst.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .pair_table import NONE, PairTable

#: Fixed values of the vocabulary format: white space of its pattern, and the pre-token pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\p{Z}"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Code points that the regex package counts as letters or numbers, and the
#: library, whose Unicode tables are older, as neither.
NEITHER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Lower case of code points that the library knows and Python does not, one by one and in runs (first, last, step to the lower case).
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER_RUNS = [(0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols and merge ranks of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        marks = byte_symbols()
        self.inner = np.array([vocab[m] for m in marks], np.int64)
        self.last = np.array([vocab[m + suffix] for m in marks], np.int64)
        self.pairs = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], np.arange(len(merges)), [vocab[a + b] for a, b in merges])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        neither = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in NEITHER)
        self.lower = LOWER | {c: c + step for a, b, step in LOWER_RUNS for c in range(a, b + 1)}
        self.newer = regex.compile(f"[{neither}{''.join(map(chr, self.lower))}]")
        letter, number = (rf"[\p{{{kind}}}--[{neither}]]" for kind in "LN")
        # Slower for its sets; only texts with such a character take it.
        self.pre_token_newer = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{neither}])+")

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each (not empty) word."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size)
        symbol = self.inner[data]
        symbol[end - 1] = self.last[data[end - 1]]
        word = np.repeat(np.arange(len(words)), size)
        while len(symbol):
            start = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            rank, made = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
            inside = np.nonzero(word[1:] == word[:-1])[0]
            rank[inside], made[inside] = self.pairs.look(symbol[inside], symbol[inside + 1])
            low = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbol)))
            done = low == NONE
            out[word[start[done]]] = size[done]
            low, live = np.repeat(low, size), np.repeat(~done, size)
            hit = (rank == low) & live
            # Of places that overlap, every second one merges, from the left.
            edge = np.nonzero(hit & ~np.concatenate([[False], hit[:-1]]))[0]
            places = np.nonzero(hit)[0]
            run = edge[np.searchsorted(edge, places, "right") - 1]
            places = places[(places - run) % 2 == 0]
            symbol[places] = made[places]
            live[places + 1] = False
            symbol, word = symbol[live], word[live]
        return out

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its number of special strings."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                # Lower case works by character, without the final form of sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.newer.search(part):
                    found += self.pre_token_newer.findall(part.translate(self.lower).lower())
                    continue
            found += self.pre_token.findall(part.lower())
        return found, len(parts) - 1


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of each whole text. ``vocabulary``: a path that every executor can read."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, known = Vocabulary(vocabulary), {}
        for texts in batches:
            out = []
            # A few hundred texts at a time bound the memory that pre-tokens take.
            for k in range(0, len(texts), 256):
                cut = [vocab.pre_tokens(t or "") for t in texts.iloc[k : k + 256]]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set().union(*(words for words, _ in cut)) - known.keys())
                if new:
                    known.update(zip(new, vocab.counts([w.encode() for w in new]).tolist(), strict=True))
                out += [sum(map(known.__getitem__, words)) + special for words, special in cut]
            yield pd.Series(out, dtype="int64")
        give_back()

    return docs.withColumn(count_col, count(F.col(text_col)))
