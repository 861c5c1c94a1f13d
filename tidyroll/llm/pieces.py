"""Texts as pieces that byte-level pre-tokenizers never join, and a bounded memory of them."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered pieces.
REMEMBERED = 16 << 20
MARKS = string.punctuation
#: Digits and letters that every version of Unicode has, so all libraries take them for such.
WORD_END = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u052f]"
#: Texts that have to be looked at more closely: empty ones, and those with white space beside white
#: space, at an end, or of another kind than space and line feed.
_ODD = (
    r"\A\z|[ \n][ \n]|\A[ \n]|[ \n]\z"
    r"|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_OTHER = re.compile(r"[^\S \n]|\0")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """The text cut before each single space that has other characters on both sides, and on
    both sides of such a single line feed.

    A pre-token has a space in front only, and rules on white space look at its own run, so
    a pre-token never crosses such a cut and none depends on what lies beyond it.
    """
    odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    if odd or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text):
        return _BETWEEN.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Together:
    """Pieces in an order in which most can be cut into pre-tokens as one string.

    Those with a space in front come first, then those without, each behind a line feed whose
    pre-token is dropped, and then, from `alone` on, those that have to be cut by themselves.
    """

    def __init__(self, texts: list[str]):
        kind = [self._kind(t) for t in texts]
        self.order = sorted(range(len(texts)), key=kind.__getitem__)
        self.alone = len(kind) - kind.count(2)
        self.skip = np.array([kind[i] == 1 for i in self.order], np.int64)
        self.parts = ["\n" + texts[i] if kind[i] == 1 else texts[i] for i in self.order]

    @staticmethod
    def _kind(text: str) -> int:
        if text[-1].isspace():
            return 2
        if text[0] == " ":
            return 2 * text[1].isspace()
        return 2 if text[0].isspace() else 1

    def runs(self, sizes: np.ndarray, part_sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece as they were given, where its run of tokens starts, and how long it is.

        `sizes` are those of all tokens of the parts, in the unit of `part_sizes`.
        """
        ends = np.searchsorted(np.cumsum(sizes), np.cumsum(part_sizes), side="right")
        starts = np.concatenate([[0], ends[:-1]]) + self.skip
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        return starts[back], (ends - starts)[back]


def cut(texts: pa.Array | list[bytes | None], whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The `pieces` of texts (or texts in one, if `whole`), one text after another, and how many each has."""
    raw = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), b"")
    try:
        values = raw.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        values = pa.array([t.decode(errors="replace") for t in raw.to_pylist()], pa.string())
    if whole:
        some = pc.greater(pc.binary_length(values), 0)
        return values.filter(some), some.cast(pa.int64()).to_numpy()
    odd = pc.match_substring_regex(values, _ODD).to_numpy(zero_copy_only=False)
    plain = pc.replace_substring(values.filter(pa.array(~odd)), " ", "\0 ")
    plain = pc.split_pattern(pc.replace_substring(plain, "\n", "\0\n\0"), "\0")
    sizes = np.zeros(len(texts), np.int64)
    sizes[~odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    others = [pieces(t) if t else [] for t in values.filter(pa.array(odd)).to_pylist()]
    sizes[odd] = [len(x) for x in others]
    flat = plain.flatten()
    if others:
        flat = pa.concat_arrays([flat, pa.array([p for x in others for p in x], pa.string())])
        # from plain texts first to the order of the texts
        starts = np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        flat = flat.take(pa.array(ragged(np.arange(len(flat)), starts, sizes)))
    return flat, sizes


class PieceIds:
    """Token ids of texts from the ids of their pieces; each distinct piece is encoded once and
    remembered, up to a bound in bytes.

    `encode` gives the ids of pieces, one after another, and how many each has. Pieces are looked up
    as Arrow arrays, so that only new ones become Python strings. `special` are strings that are
    tokens wherever they occur.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        most: int = REMEMBERED,
        special: Sequence[str] = (),
    ):
        self.encode, self.most, self.special = encode, most, special
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int32)

    def _bytes(self) -> int:
        return self.names.nbytes + self.ids.nbytes + self.starts.nbytes + self.used.nbytes

    def _thin(self) -> None:
        """Forget the pieces that one call alone has used; all, if the others are too many as well."""
        kept = np.flatnonzero(self.used > 1)
        names, lengths = self.names.take(pa.array(kept)), self.starts[kept + 1] - self.starts[kept]
        ids = ragged(self.ids, self.starts[kept], lengths)
        self._forget()
        self._keep(names, ids, lengths)
        if self._bytes() > self.most // 2:
            self._forget()

    def of(self, texts: pa.Array | list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts, one text after another, and how many each has."""
        if self._bytes() > self.most:
            self._thin()
        flat, sizes = cut(texts)
        coded = pc.dictionary_encode(flat)
        ids, lengths = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy()
        starts, lengths = (np.cumsum(lengths) - lengths)[at], lengths[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        last = np.cumsum(sizes)
        return ragged(ids, starts, lengths), ends[last] - ends[last - sizes]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after another, and how many each has."""
        words, marks, marked = self._parts(pieces)
        coded = pc.dictionary_encode(pa.concat_arrays([words, marks]))
        known = pc.index_in(coded.dictionary, value_set=self.names)
        known = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = len(self.names) + np.arange(len(missing))
            new = coded.dictionary.take(pa.array(missing))
            self._keep(new, *self.encode(new.to_pylist()))
        self.used[known] += 1
        known = known[coded.indices.to_numpy()]
        # each word, and its marks behind it
        parts = 1 + marked.astype(np.int64)
        first = np.cumsum(parts) - parts
        order = np.empty(len(known), np.int64)
        order[first] = known[: len(pieces)]
        order[first[marked] + 1] = known[len(pieces) :]
        lengths = self.starts[order + 1] - self.starts[order]
        ids = ragged(self.ids, self.starts[order], lengths)
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return ids, sums[first + parts] - sums[first]

    def _parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """The pieces without the marks at the end of a word, the marks, and which pieces have any.

        Such marks are pre-tokens of their own, so a word is encoded without them, but for special
        strings, which may end with marks.
        """
        bare = pc.ascii_rtrim(pieces, characters=MARKS)
        some = pc.and_(pc.less(pc.binary_length(bare), pc.binary_length(pieces)), pc.match_substring_regex(bare, WORD_END + r"\z"))
        for string in self.special:
            some = pc.and_(some, pc.invert(pc.match_substring(pieces, string)))
        marked = some.to_numpy(zero_copy_only=False)
        words = pc.if_else(some, bare, pieces)
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset).astype(np.int64)
        starts = offsets[:-1][marked] + pc.binary_length(bare).to_numpy()[marked]
        sizes = offsets[1:][marked] - starts
        data = np.frombuffer(pieces.buffers()[2], np.uint8) if len(starts) else np.zeros(0, np.uint8)
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes)]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(ragged(data, starts, sizes)))
        return words, marks, marked

    def _keep(self, new: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32, copy=False)])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """`values[s : s + n]` for each start and length, one after another."""
    if not len(starts):
        return values[:0]
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
    return values[steps]
