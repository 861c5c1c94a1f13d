"""Byte-level BPE encoding and decoding.

Distinct pre-tokens are put into matrices by length: a row holds the ids of one pre-token,
padded to the width of its length bucket. In each round every row merges its leftmost pair of
minimum rank; pairs are looked up in a hash table, merged rows close up, and finished rows
leave the matrix. Ranks are those of a rank file: a pair merges if the bytes of both make a
token, with that token's id as its rank.

Null and empty texts have no ids and decode to no bytes. Bytes that aren't UTF-8 are read as
U+FFFD, which then is what decoding gives. Ties between equal ranks go to the left; repeated
rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pair_table import NONE, PairTable
from .pieces import PieceIds, Together, ragged
from .texts import per_text
from .worker import held

#: Widths of the length buckets, in bytes. Longer pre-tokens merge in a list with a heap,
#: as a row of a matrix would cost a pass over its width for each merge.
WIDTHS = (4, 8, 16, 32, 64, 128, 512, 4096)
ROWS = 1 << 15


class ByteBpe:
    """The tokenizer of a rank file, with a pattern that makes the pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        result = np.array(made, np.int32)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), result, result)
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_ends = np.cumsum(lengths)
        self.token_lengths = lengths
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.memory = PieceIds(self._pieces)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as unsigned 32-bit integers."""
        ids, counts = self.memory.of(texts)
        return np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one token after another."""
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        starts = self.token_ends[ids] - lengths
        at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        return self.token_bytes[at].tobytes()

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        todo = Together(texts)
        cut = self.pattern.findall("".join(todo.parts[: todo.alone]))
        for part in todo.parts[todo.alone :]:
            cut += self.pattern.findall(part)
        distinct = dict.fromkeys(cut)
        distinct = dict(zip(distinct, range(len(distinct)), strict=True))
        ids, lengths = self.pretokens([t.encode() for t in distinct])
        at = np.fromiter(map(distinct.__getitem__, cut), np.int64, len(cut))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        first, counts = todo.runs(sizes, [len(p) for p in todo.parts])
        at = ragged(at, first, counts)
        starts = np.cumsum(lengths) - lengths
        totals = np.add.reduceat(lengths[at], np.cumsum(counts) - counts)
        return ragged(ids, starts[at], lengths[at]), totals

    def pretokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has."""
        count = len(tokens)
        whole = np.fromiter((self.ranks.get(t, -1) for t in tokens), np.int64, count)
        sizes = np.fromiter(map(len, tokens), np.int64, count)
        lengths = np.ones(count, np.int64)
        known = np.flatnonzero(whole >= 0)
        parts = [(known, whole[known])]
        bucket = np.where(whole >= 0, -1, np.searchsorted(WIDTHS, sizes))
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            ids = self._long(tokens[i])
            lengths[i] = len(ids)
            parts.append((np.array([i]), ids))
        for k, width in enumerate(WIDTHS):
            members = np.flatnonzero(bucket == k)
            rows = max(1, ROWS * WIDTHS[1] // width)
            for start in range(0, len(members), rows):
                some = members[start : start + rows]
                ids, lengths[some] = self._matrix([tokens[i] for i in some], width)
                parts.append((some, ids))
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        for members, ids in parts:
            n = lengths[members]
            out[np.arange(len(ids)) + np.repeat(starts[members] - np.cumsum(n) + n, n)] = ids
        return out, lengths

    def _matrix(self, tokens: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(tokens)
        raw = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in tokens]), np.uint8)
        lengths = np.fromiter(map(len, tokens), np.int64, count)
        ids = self.byte_ids[raw].reshape(count, width)
        columns = np.arange(width)
        ranks = np.full((count, width), NONE, np.int32)
        slots = self.pairs.slots(ids[:, :-1], ids[:, 1:])
        pair = columns[:-1] < lengths[:, None] - 1
        ranks[:, :-1] = np.where(pair, self.pairs.ranks[slots], NONE)
        out = np.zeros((count, width), np.uint32)
        sizes = np.zeros(count, np.int64)
        rows = np.arange(count)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                sizes[rows[done]] = lengths[done]
                keep = ~done
                ids, ranks, lengths = ids[keep], ranks[keep], lengths[keep]
                rows, at, best = rows[keep], at[keep], best[keep]
                if not len(rows):
                    return out[columns < sizes[:, None]], sizes
            live = np.arange(len(rows))
            # the merged row closes up behind the pair
            most = int(lengths.max())
            source = columns[:most] + (columns[:most] > at[:, None])
            np.minimum(source, ids.shape[1] - 1, out=source)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ids[live, at] = best
            lengths = lengths - 1
            self._rank_pairs(ids, ranks, lengths, live, at)
            self._rank_pairs(ids, ranks, lengths, live[at > 0], at[at > 0] - 1)
            ranks[live, lengths - 1] = NONE

    def _rank_pairs(self, ids, ranks, lengths, rows, at) -> None:
        """Ranks of the pairs that begin at `at`."""
        inside = at < lengths[rows] - 1
        rows, at = rows[inside], at[inside]
        ranks[rows, at] = self.pairs.ranks[self.pairs.slots(ids[rows, at], ids[rows, at + 1])]

    def _long(self, token: bytes) -> np.ndarray:
        """The same merges in a linked list, by a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        pairs = self.pairs.ranks[self.pairs.slots(ids[:-1], ids[1:])]
        ids = ids.tolist()
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(pairs.tolist()) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                slot = self.pairs.slots(np.array([ids[i]]), np.array([ids[after[i]]]))
                rank = int(self.pairs.ranks[slot[0]])
                if rank != NONE:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return np.array([x for x in ids if x >= 0], np.uint32)


def load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file; kept by a Python worker for its next tasks."""

    def make() -> ByteBpe:
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        return ByteBpe(ranks, pattern)

    return held(("byte_bpe", path, pattern), make)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Ids and decoded bytes of whole texts: row (struct of `carry`), ids, decoded.

    `path` is a rank file that every executor has at the same place.
    """

    def make():
        bpe = load(path, pattern)

        def process(texts):
            ids = bpe.encode(texts)
            return (
                pa.array(ids, pa.list_(pa.int32())),
                pa.array([bpe.decode(i) for i in ids], pa.binary()),
            )

        return process

    return per_text(docs, "ids array<int>, decoded binary", make, text, carry)


def digests(
    docs: DataFrame, path: str, pattern: str, text: str = "text", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """As `encode`, with n_tokens and SHA-256 of ids and decoded bytes, made where the ids are."""

    def make():
        bpe = load(path, pattern)

        def process(texts):
            ids = bpe.encode(texts)
            return (
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
            )

        return process

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(docs, fields, make, text, carry)
