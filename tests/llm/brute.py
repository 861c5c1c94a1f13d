"""Plain versions of the operators over Python lists, by other methods than the operators'."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def contamination(docs, items, size=10):
    patterns = {}
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            patterns.setdefault(tuple(words[k : k + size]), set()).add(item)
    lengths = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in range(len(words)):
            for n in lengths:
                if (p := tuple(words[k : k + n])) in patterns and len(p) == n:
                    hit |= set(range(k, k + n))
                    found |= patterns[p]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return out


def byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    from tidyroll.llm.byte_bpe import load

    ranks = load(path, public_tokenizers.PATTERN).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in docs:
        ids = own.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    return out


def token_store(docs, end=2):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def token_counts(docs, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in docs:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out.append((doc, len((text or "").encode()), n, n > limit))
    return out


def top_k(rows, every=50, k=5, scale=256):
    valid = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.append((i, tuple(int(np.floor(scale * float(x))) for x in v)))
    valid = sorted(set(valid))
    out = []
    for q, a in valid:
        if q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in valid if i != q and len(b) == len(a)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def fingerprint(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, distance=3, size=3):
    prints = [fingerprint(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(docs)]


def suffix_spans(texts, threshold):
    """Which bytes of each text go."""
    counts = Counter(t[i : i + threshold] for t in texts for i in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - threshold + 1):
            if counts[t[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        out.append(gone)
    return out


def suffix_dedup(docs, threshold=400):
    texts = [(t or "").encode() if not isinstance(t, bytes) else t for _, t in docs]
    out = []
    for (doc, _), t, gone in zip(docs, texts, suffix_spans(texts, threshold), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(t), sum(gone), spans, sha(kept)))
    return out


def window_dedup(docs, window=20):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), sha(kept.encode())))
    return out


def merkle(docs):
    """Rows of (doc_id, source, lang, n_chars, text)."""

    def h(text):
        return sha(text.encode())

    def leaf(row, low=False):
        text = row[4].translate(LOWER) if low and row[4] is not None else row[4]
        fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
        return h("".join(fields))

    steps = [[] for _ in docs]

    def root(nodes, members):
        while len(nodes) > 1:
            runs = [range(k, min(k + 16, len(nodes))) for k in range(0, len(nodes), 16)]
            for run in runs:
                for own in run:
                    step = "".join(nodes[run[0] : own]), "".join(nodes[own + 1 : run[-1] + 1])
                    for i in members[own]:
                        steps[i].append(step)
            nodes, members = (
                [h("".join(nodes[k] for k in run)) for run in runs],
                [[i for k in run for i in members[k]] for run in runs],
            )
        return nodes[0] if nodes else None

    by_source = {}
    for i, row in enumerate(docs):
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), i))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    rows = {s: sorted(by_source[s]) for s in order}
    subroots = {s: root([r[2] for r in rows[s]], [[r[3]] for r in rows[s]]) for s in order}
    whole = root([subroots[s] for s in order], [[r[3] for r in rows[s]] for s in order])
    out = []
    for row, path in zip(docs, steps, strict=True):
        folded = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
        for first, last in path:
            folded = h(first + folded + last)
        proof = h("".join(a + b for a, b in path))
        out.append((row[0], leaf(row), subroots[row[1]], whole, proof, folded, folded == whole))
    return out


def sharding(docs, shards=16):
    """One heap over all groups; rows that are equal have slots beside each other."""
    groups = {}
    for doc, text in docs:
        key = b"" if text is None else hashlib.sha256(text.encode()).digest()
        groups.setdefault(key, []).append((doc is not None, doc or 0, key, doc, text or ""))
    bytes_of = {k: sum(len(r[4].encode()) + 1 for r in g) for k, g in groups.items()}
    heap = [(0, s) for s in range(shards)]
    held = [[] for _ in heap]
    for key in sorted(groups, key=lambda k: (-bytes_of[k], k)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + bytes_of[key], shard))
        held[shard] += groups[key]
    return [
        (r[3], len(r[4].encode()) + 1, zlib.crc32(r[4].encode()), "bytes", shard, slot, None)
        for shard, members in enumerate(held)
        for slot, r in enumerate(sorted(members, key=lambda r: r[:3]))
    ]


def token_bytes():
    """Ids of both tokenizers for a text, and the bytes of each id."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in prints}
    byte_of |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in prints)}

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("\u2581", " ").encode()

    def both(text):
        if not text:
            return [], []
        one = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, spell_b(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        same = all(b"".join(x for _, x in side) == raw for side in (one, other))
        return (one, other) if same else ([], [])

    return both


def alignment(docs):
    both = token_bytes()
    rows, counts = [], Counter()
    for doc, text in docs:
        sides = []
        for side in both(text):
            at, ranges = 0, []
            for i, raw in side:
                ranges.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append(ranges)
        links, low = [], 0
        for i, start, end in sides[0]:
            while low < len(sides[1]) and sides[1][low][2] <= start:
                low += 1
            at = low
            while at < len(sides[1]) and sides[1][at][1] < end:
                links.append((i, sides[1][at][0]))
                at += 1
        counts.update(links)
        ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
        parts, at = [], [0, 0]
        for end in ends:
            names = []
            for k, side in enumerate(sides):
                first = at[k]
                while at[k] < len(side) and side[at[k]][2] <= end:
                    at[k] += 1
                names.append(",".join(str(i) for i, _, _ in side[first : at[k]]))
            parts.append("|".join(names))
        rows.append((doc, sides, ends, links, sha(";".join(parts).encode()) if parts else ""))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return [
        (doc, len(a), len(b), len(ends), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for doc, (a, b), ends, links, groups in rows
    ]
