"""Token counts of a lower-case word BPE, without making the tokens.

Distinct words are cut into pre-tokens, and the pre-tokens of a batch lie one after another in
ragged arrays of symbols. In each round every pre-token takes its pair of lowest rank and merges
all places of that pair at once, from the left where they overlap; the symbols that are left in
the end are counted. Merging all places at once gives what one place after another gives as
long as no merge with the new symbol has a lower rank; where a merge list has such a pair, that
pair merges in its leftmost place only and the next round decides anew.

Null and empty texts, and texts of white space, have no tokens. Special strings inside a text
count as one token each. Bytes that aren't UTF-8 are read as U+FFFD. Repeated rows are counted
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pair_table import NONE, PairTable
from .texts import per_text
from .worker import Words, held

#: Symbols that merge together in one array.
SYMBOLS = 1 << 21
#: White space to `str.split`, but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    others = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """Counts with the vocabulary of a tokenizer file: NFC, lower case, pattern, word-end BPE."""

    def __init__(self, spec: dict):
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["use_regex"]:
            raise ValueError("not a lower-case word BPE")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int32)
        self.pairs = PairTable(left, right, rank, made.astype(np.int32))
        # the lowest rank of a merge that uses each symbol
        used = np.full(max(vocab.values()) + 1, NONE, np.int32)
        np.minimum.at(used, left, rank)
        np.minimum.at(used, right, rank)
        self.at_once = used[made] > rank
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.known = Words(self._words)

    def counts(self, texts: Sequence[str]) -> list[int]:
        """The number of tokens of each text."""
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text)
            extra.append(len(parts) - 1)
            words: list[str] = []
            for part in parts:
                odd = _SEPARATORS.search(part)
                words += filter(None, _SPACE.split(part)) if odd else part.split()
            cut.append(words)
        self.known.learn(set().union(*cut))
        return [sum(map(self.known.__getitem__, w)) + n for w, n in zip(cut, extra, strict=True)]

    def _words(self, words: list[str]) -> list[int]:
        """Tokens of each word; words are matched together, with a space between."""
        text = " ".join(map(_lower, words))
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        cut = [(m.end(), m.group()) for m in self.pattern.finditer(text)]
        distinct = dict.fromkeys(t for _, t in cut)
        distinct = dict(zip(distinct, range(len(distinct)), strict=True))
        counts = self.pretokens([t.encode() for t in distinct])
        at = np.fromiter((distinct[t] for _, t in cut), np.int64, len(cut))
        word = np.searchsorted(ends, [e for e, _ in cut], side="left")
        return np.bincount(word, counts[at], minlength=len(words)).astype(np.int64).tolist()

    def pretokens(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(tokens):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SYMBOLS, side="right")))
            out[start:end] = self._merge(tokens[start:end], lengths[start:end])
            start = end
        return out

    def _merge(self, tokens: list[bytes], lengths: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[raw]
        tail = np.cumsum(lengths) - 1
        symbols[tail] = self.last[raw[tail]]
        rows = np.arange(len(tokens))
        out = np.ones(len(tokens), np.int64)
        while len(rows):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            slots = self.pairs.slots(symbols[:-1], symbols[1:])
            ranks = np.append(self.pairs.ranks[slots], NONE)
            ranks[ends - 1] = NONE
            best = np.minimum.reduceat(ranks, starts)
            merging = best != NONE
            out[rows[~merging]] = lengths[~merging]
            row_of = np.repeat(np.arange(len(rows)), lengths)
            hit = (ranks != NONE) & (ranks == best[row_of])
            places = np.flatnonzero(hit)
            # of places that follow each other, every second one from the left
            gap = np.diff(places, prepend=-2) != 1
            run = np.flatnonzero(gap)[np.cumsum(gap) - 1]
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            row = row_of[places]
            first = np.diff(row, prepend=-1) != 0
            places = places[first | self.at_once[ranks[places]]]
            symbols[places] = self.pairs.results[slots[places]]
            keep = merging[row_of]
            keep[places + 1] = False
            symbols = symbols[keep]
            lengths = (lengths - np.bincount(row_of[places], minlength=len(rows)))[merging]
            rows = rows[merging]
        return out


def _lower(word: str) -> str:
    """NFC, then each letter in lower case by itself; white space can't be in a word."""
    word = unicodedata.normalize("NFC", word)
    return "".join(map(str.lower, word)) if "Σ" in word else word.lower()


def load(path: str) -> WordBpe:
    """The counter of a tokenizer file; kept by a Python worker for its next tasks."""
    return held(("token_counts", path), lambda: WordBpe(json.loads(Path(path).read_text("utf-8"))))


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Bytes and tokens of whole texts: row (struct of `carry`), n_bytes, n_tokens, over_limit.

    `path` is a tokenizer file that every executor has at the same place.
    """

    def make():
        bpe = load(path)

        def process(texts):
            n = bpe.counts([(t or b"").decode(errors="replace") for t in texts])
            return (
                pa.array([len(t or b"") for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            )

        return process

    return per_text(docs, "n_bytes long, n_tokens long, over_limit boolean", make, text, carry)
