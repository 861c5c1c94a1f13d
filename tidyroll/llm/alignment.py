"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte fallback; both read a
space and the text. A token covers the bytes that it stands for. `merge_asof`, keyed by document, finds
for the start of each token of one side the covering token of the other; both directions together
are all pairs of tokens that overlap, and ends that both sides share cut the tokens into groups.

Texts are cut where neither tokenizer can join (see `pieces`), which both vocabularies are checked
for, so a token of either side ends at each cut, and pieces align as documents of their own. Each
distinct piece of a task is aligned once, a batch of new pieces at a time, and remembered up to a
bound in bytes.

Counts of id pairs over the corpus take two passes: the first writes chunks of documents (numbers of
their pieces, and the linked pairs of those with how often they occur), Spark sums pairs over chunks
and finds the highest of each B id, and the second adds the sums up by document. A pair meets a chunk
once however often it occurs there, so no key has more rows than there are chunks.

Null and empty texts have no tokens, nor has a text whose tokens' bytes, of A or of B, aren't the
space and the text (such as one that holds U+2581): their numbers are 0 and their groups ''. Strings
of special tokens are plain text. Ties: a pair whose count is the highest of its B id is best, with
all that share it. Repeated rows count as often as they occur and get equal results. An empty table
gives an empty result. A very long text is a chunk of its own. Columns that aren't carried don't
travel; carried ones come back in the struct `row`, where they can't clash with the results.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyroll.operators.staging import stage

from .pieces import MARKS, WORD_END, Together, cut, ragged
from .texts import chunks, per_text
from .token_counts import _byte_letters
from .worker import ENTRY_BYTES, MEMORY_BYTES, held

#: Pieces that are joined to one string for the library of A.
JOINED = 4096
#: Bytes of remembered alignments, by estimate, new pieces that are aligned at once, and texts of a chunk.
REMEMBERED, BATCH, CHUNK_BYTES = MEMORY_BYTES, 1 << 15, 1 << 20
_B_MASK = (1 << 32) - 1
_WORD_END = re.compile(WORD_END + r"\Z")


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of overlapping tokens: the rows `a` and `b` of the two frames.

    Frames hold doc, start (rising over all rows; a document's tokens follow each other without gaps,
    those of both sides over the same bytes) and are numbered from 0.
    """
    a, b = a[["doc", "start"]].assign(a=np.arange(len(a))), b[["doc", "start"]].assign(b=np.arange(len(b)))
    one = pd.merge_asof(a, b.assign(at=b["start"]), on="start", by="doc")
    other = pd.merge_asof(b, a.assign(at=a["start"]), on="start", by="doc")
    # a pair that starts together is found from both sides
    other = other[other["at"] < other["start"]]
    return pd.concat([one[["a", "b"]], other[["a", "b"]]]).sort_values(["a", "b"], ignore_index=True)


class Sides:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        words = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte_of[c] for c in words.get(i, "")) for i in range(max(words) + 1)]
        self.b = SentencePieceProcessor(model_file=path_b)
        known = range(self.b.get_piece_size())
        spelled = [self.b.id_to_piece(i) for i in known]
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(known, spelled, strict=True)
        ]
        # no piece goes on behind a space inside or over a line feed: texts can be cut there
        self.cuts = not any(" " in p.replace("▁", " ").lstrip(" ") or "\n" in p for p in spelled)
        # what some piece of B joins to a mark behind it
        self.joined = {p[i : i + 2] for p in spelled for i in range(len(p) - 1) if p[i + 1] in MARKS}
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_names = [str(i) for i in range(len(self.a_bytes))]
        self.b_names = [str(i) for i in known]

    def cut(self, texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of a space and each UTF-8 text, one text after another, and how many each has;
        null and empty texts have none."""
        flat, sizes = cut(texts, whole=not self.cuts)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        spaces = pc.if_else(pa.array(first), " ", "")
        return pc.binary_join_element_wise(spaces, flat, ""), sizes

    def word(self, piece: str) -> str:
        """The piece without the marks at its end, if both tokenizers end a token there; else all."""
        if not self.cuts or piece[-1] not in MARKS:
            return piece
        word = piece.rstrip(MARKS)
        apart = _WORD_END.search(word) and piece[len(word) - 1 : len(word) + 1] not in self.joined
        return word if apart else piece

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        todo = Together(texts)
        strings = ["".join(todo.parts[k : min(todo.alone, k + JOINED)]) for k in range(0, todo.alone, JOINED)]
        strings += todo.parts[todo.alone :]
        found = self.a.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int64) for e in found])
        starts, counts = todo.runs(self.a_sizes[ids], [len(p.encode()) for p in todo.parts])
        return ragged(ids, starts, counts), counts

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `encode_a`. The model puts a space in front itself; where a text has none, a line feed
        parts it from that space, and the tokens of both are dropped."""
        bare = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        found = self.b.encode(bare, out_type=int, num_threads=1)
        found = [f if t[0] == " " else f[2:] for f, t in zip(found, texts, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for f in found for i in f], np.int64), counts


class Aligned:
    """The alignment of pieces, each made once and remembered: numbers of tokens of both sides, of
    groups and of links, the groups as text, the linked pairs (A id in the high bits), and whether
    both sides' bytes are the piece."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, sides: Sides):
        self.sides = sides
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.whole = np.zeros(0, bool)
        self.numbers = np.zeros((0, len(self.FIELDS)), np.int64)
        self.groups: list[str] = []
        self.pairs = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Forget the pieces that one call alone has used; all, if the others are too many as well."""
        names, kept = list(self.known), np.flatnonzero(self.used > 1)
        numbers, sizes = self.numbers[kept], self.ends[kept + 1] - self.ends[kept]
        pairs = ragged(self.pairs, self.ends[kept], sizes)
        groups, whole = [self.groups[i] for i in kept.tolist()], self.whole[kept]
        names = [names[i] for i in kept.tolist()]
        self._forget()
        if self._size(names, groups, pairs) < REMEMBERED // 2:
            self._keep(names, whole, numbers, groups, pairs, sizes)

    @staticmethod
    def _size(names: list[str], groups: list[str], pairs: np.ndarray) -> int:
        return 2 * ENTRY_BYTES * len(names) + sum(map(len, names)) + sum(map(len, groups)) + 8 * len(pairs)

    def _keep(self, names, whole, numbers, groups, pairs, sizes) -> None:
        size = len(self.known)
        self.known.update(zip(names, range(size, size + len(names)), strict=True))
        self.bytes += self._size(names, groups, pairs)
        self.whole = np.concatenate([self.whole, whole])
        self.numbers = np.concatenate([self.numbers, numbers])
        self.groups += groups
        self.pairs = np.concatenate([self.pairs, pairs])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int32)])

    def documents(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' pieces, one text after another, and how many each has; a text
        without tokens has none."""
        if self.bytes > REMEMBERED:
            self._thin()
        flat, sizes = self.sides.cut(texts)
        coded = pc.dictionary_encode(flat)
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.used[known] += 1
        at = known[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), sizes)
        odd = np.unique(text[~self.whole[at]])
        if len(odd):
            parts = np.split(at, np.cumsum(sizes)[:-1])
            for i in odd.tolist():
                start = int(sizes[:i].sum())
                parts[i] = self._in_one(flat[start : start + int(sizes[i])].to_pylist())
            at, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return at, sizes

    def _in_one(self, cut: list[str]) -> np.ndarray:
        """The number of a text as one piece, if its tokens spell it though those of its pieces don't."""
        text = "".join(cut)
        raw = text.encode()
        for encode, spelled in ((self.sides.encode_a, self.sides.a_bytes), (self.sides.encode_b, self.sides.b_bytes)):
            if b"".join(spelled[i] for i in encode(cut)[0].tolist()) != raw:
                return np.zeros(0, np.int64)
        self._learn([text])
        return np.array([self.known[text]])

    def _learn(self, wanted: list[str]) -> None:
        """Words are aligned without the marks behind them, and put together with those."""
        known = self.known
        new = [p for p in wanted if p not in known]
        words = [self.sides.word(p) for p in new]
        marked = {p: (w, p[len(w) :]) for p, w in zip(new, words, strict=True) if len(w) < len(p)}
        plain = dict.fromkeys(p for p in new if p not in marked)
        plain |= dict.fromkeys(part for both in marked.values() for part in both if part not in known)
        base = list(plain)
        # the libraries' results of a batch take many times its size
        for k in range(0, len(base), BATCH):
            self._align(base[k : k + BATCH])
        if marked:
            both = np.array([(known[w], known[m]) for w, m in marked.values()], np.int64)
            sizes = self.ends[both + 1] - self.ends[both]
            pairs = ragged(self.pairs, self.ends[both].reshape(-1), sizes.reshape(-1))
            groups = [self.groups[i] + ";" + self.groups[j] for i, j in both.tolist()]
            whole, numbers = self.whole[both].all(axis=1), self.numbers[both].sum(axis=1)
            self._keep(list(marked), whole, numbers, groups, pairs, sizes.sum(axis=1))

    def _align(self, new: list[str]) -> None:
        sides, raw = self.sides, [p.encode() for p in new]
        a, n_a = sides.encode_a(new)
        b, n_b = sides.encode_b(new)
        whole = self._spell(a, n_a, sides.a_bytes, raw) & self._spell(b, n_b, sides.b_bytes, raw)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)

        def frame(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
            ends = np.cumsum(sizes[ids])  # over the pieces that are whole, the same bytes on both sides
            return pd.DataFrame({"doc": np.repeat(np.arange(len(new)), counts), "start": ends - sizes[ids], "end": ends, "id": ids})

        left, right = frame(a, n_a, sides.a_sizes), frame(b, n_b, sides.b_sizes)
        links = overlaps(left, right)
        at = links["a"].to_numpy()
        doc = left["doc"].to_numpy()
        n_links = np.bincount(doc[at], minlength=len(new))
        pairs = a[at] << 32 | b[links["b"].to_numpy()]
        cut_a, cut_b, n_groups = self._cuts(left, right, len(new))
        names_a, names_b = sides.a_names, sides.b_names
        named_a, named_b = [names_a[i] for i in a.tolist()], [names_b[i] for i in b.tolist()]
        groups = [
            ",".join(named_a[i:j]) + "|" + ",".join(named_b[k:m])
            for i, j, k, m in zip([0, *cut_a[:-1]], cut_a, [0, *cut_b[:-1]], cut_b, strict=True)
        ]
        ends = np.cumsum(n_groups).tolist()
        texts = [";".join(groups[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

        numbers = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        self._keep(new, whole, numbers, texts, pairs, n_links)

    @staticmethod
    def _spell(ids: np.ndarray, counts: np.ndarray, spelled: list[bytes], raw: list[bytes]) -> np.ndarray:
        """Which pieces their tokens spell."""
        found = [spelled[i] for i in ids.tolist()]
        if sum(map(len, found)) == sum(map(len, raw)) and b"".join(found) == b"".join(raw):
            sizes = np.add.reduceat(np.fromiter(map(len, found), np.int64, len(found)), np.cumsum(counts) - counts) if (counts > 0).all() else None
            if sizes is not None and (sizes == np.fromiter(map(len, raw), np.int64, len(raw))).all():
                return np.ones(len(raw), bool)
        ends = np.cumsum(counts).tolist()
        return np.array([b"".join(found[i:j]) == r for i, j, r in zip([0, *ends[:-1]], ends, raw, strict=True)], bool)

    @staticmethod
    def _cuts(left: pd.DataFrame, right: pd.DataFrame, count: int) -> tuple[list[int], list[int], np.ndarray]:
        """How many tokens of each side come before each end that both share, and groups by piece."""
        _, at, other = np.intersect1d(left["end"].to_numpy(), right["end"].to_numpy(), assume_unique=True, return_indices=True)
        doc = left["doc"].to_numpy()[at]
        return (at + 1).tolist(), (other + 1).tolist(), np.bincount(doc, minlength=count)


def _load(path_a: str, path_b: str) -> Aligned:
    return held(("alignment", path_a, path_b), lambda: Aligned(Sides(path_a, path_b)))


def _by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `values` (one for each piece) by text."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The groups of whole texts as text: row (struct of `carry`), groups (`a1,a2|b1;a3|b2,b3`)."""

    def make():
        def process(texts):
            aligned = _load(path_a, path_b)
            at, counts = aligned.documents(texts)
            named = [aligned.groups[i] for i in at.tolist()]
            ends = np.cumsum(counts).tolist()
            return (pa.array([";".join(named[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.string()),)

        return process

    return per_text(docs, "groups string", make, text, carry)


RESULTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: pieces: those of each text, as numbers of the chunk; sizes: how many each text has; links, link_sizes:
#: for each distinct piece, its pairs as numbers of the chunk; pairs, n: the pairs, and links that have them.
CHUNK = "pieces binary, sizes binary, links binary, link_sizes binary, pairs array<long>, n array<long>"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up, as bytes of the narrowest width, compressed."""
    width = np.min_scalar_type(int(numbers.max(initial=0)))
    raw = numbers.astype(width.newbyteorder("<")).tobytes()
    return bytes([width.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{data[0]}").astype(np.int64)


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks of documents, staged: chunk, rows (structs of `carry`, `results`), and the fields of CHUNK."""
    frame = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    results = T.StructType.fromDDL(RESULTS)
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("rows", T.ArrayType(frame.schema["row"].dataType)),
            T.StructField("results", T.ArrayType(results)),
            *T.StructType.fromDDL(CHUNK).fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _load(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in chunks(batch.column(1), CHUNK_BYTES):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                yield _chunk(aligned, chunk, batch.column(0).slice(start, end - start), texts)
                chunk += 1

    return stage(frame.mapInArrow(run, schema), "aligned")


def _chunk(aligned: Aligned, chunk: int, rows: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    at, counts = aligned.documents(texts)
    named = aligned.groups
    flat, ends = at.tolist(), np.cumsum(counts).tolist()
    hashes = [
        hashlib.sha256(";".join([named[k] for k in flat[i:j]]).encode()).hexdigest() if i < j else ""
        for i, j in zip([0, *ends[:-1]], ends, strict=True)
    ]
    numbers = _by_text(aligned.numbers[at], counts)
    results = pa.StructArray.from_arrays(
        [*(pa.array(numbers[:, k]) for k in range(numbers.shape[1])), pa.array(hashes, pa.string())],
        names=[*Aligned.FIELDS, "groups_sha256"],
    )
    distinct, inverse, often = np.unique(at, return_inverse=True, return_counts=True)
    link_sizes = aligned.ends[distinct + 1] - aligned.ends[distinct]
    codes = ragged(aligned.pairs, aligned.ends[distinct], link_sizes)
    pairs, links = np.unique(codes, return_inverse=True)
    n = np.bincount(links, np.repeat(often, link_sizes), len(pairs)).astype(np.int64)

    arrays = [
        pa.array([chunk], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), results),
        *(pa.array([packed(x)], pa.binary()) for x in (inverse, counts, links, link_sizes)),
        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, n)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "rows", "results", "pieces", "sizes", "links", "link_sizes", "pairs", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """The linked id pairs of chunks: pair (A id in the high 32 bits), a_id, b_id, count (links over
    the whole corpus that hold the pair), best (whether that is the highest of its B id)."""
    each = found.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("x.pairs", "x.n")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count"))
    counts = counts.select(
        "pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(_B_MASK)).cast("int").alias("b_id"), "count"
    )
    counts = stage(counts, "pairs")
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of `carry`), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are the links whose pair is the best of its B id, count_sum the sum of the counts of all
    links. Both paths are tokenizer files that every executor has at the same place.
    """
    found = aligned_chunks(docs, path_a, path_b, text, carry)
    counts = stage(pair_counts(found), "counts")
    wanted = found.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    met = wanted.join(counts.select("pair", "count", "best"), "pair")
    # no more than a chunk has pairs
    told = met.groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    joined = found.drop("pairs", "n").join(told, "chunk", "left").drop("chunk")
    fields = [*T.StructType.fromDDL(RESULTS).fields, *T.StructType.fromDDL("n_best long, count_sum long").fields]
    schema = T.StructType([T.StructField("row", found.schema["rows"].dataType.elementType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                rows, results = one["rows"].values, one["results"].values
                told = one["told"].values
                amounts = np.zeros((0 if told is None else len(told), 2), np.int64)
                if told is not None:
                    at = told.field("at").to_numpy()
                    amounts[at, 0] = told.field("best").to_numpy(zero_copy_only=False)
                    amounts[at, 1] = told.field("count").to_numpy()
                pieces, sizes, links, link_sizes = (
                    unpacked(one[c].as_py()) for c in ("pieces", "sizes", "links", "link_sizes")
                )
                by_piece = _by_text(amounts[links], link_sizes)
                sums = _by_text(by_piece[pieces], sizes)
                yield pa.RecordBatch.from_arrays(
                    [rows, *(results.field(k) for k in range(results.type.num_fields)), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                    names=["row", *(f.name for f in fields)],
                )

    return joined.mapInArrow(run, schema)
