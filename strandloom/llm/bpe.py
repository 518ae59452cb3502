"""Byte-level BPE encoding and decoding.

Two-tier lookup. A minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves; the
rest goes through a heap of mergeable pairs over a doubly linked list of bytes, O(n log n) in the pre-token's length.

The vocabulary is a fixed file (tens of thousands of entries), so the tables built from it are the only thing sent to
every executor and do not grow with the data. There is no shuffle: a lost task is rerun from its input split.

Defined results: null text encodes as empty text (no ids); an empty table gives an empty table; repeated rows are
encoded each; other columns are dropped. Unknown ids on decoding raise KeyError-like IndexError, as they can only come
from another vocabulary.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from strandloom.llm.common import pick, pieces

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(1) * np.asarray(seed, np.uint64) * _GOLD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Hash and displace: keys fall into buckets; each bucket stores the seed that sends its keys to free slots.

    As many slots as keys. Buckets of one key are placed last and store their slot directly (as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        h = self.hashes(keys)
        self.n, self.buckets = n, max(1, n // 3)
        self.seed = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        which = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(which[order]), 1)) + 1
        groups = sorted(np.split(order, ends[:-1]), key=len, reverse=True)
        for members in groups:
            bucket = which[members[0]]
            if len(members) == 1:
                continue
            base = 0
            while True:
                seeds = np.arange(base, base + 512, dtype=np.uint64)
                slots = (_mixed(h[members][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
                fits = free[slots].all(axis=1)
                for k in np.flatnonzero(fits):
                    if len(set(slots[k].tolist())) == len(members):
                        break
                else:
                    base += 512
                    continue
                self.seed[bucket] = base + k
                free[slots[k]] = False
                self.key_at[slots[k]] = members
                break
        open_slots = iter(np.flatnonzero(free).tolist())
        for members in groups:
            if len(members) == 1:
                slot = next(open_slots)
                self.seed[which[members[0]]] = -slot - 1
                self.key_at[slot] = members[0]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The index of each key if it is one of the keys; else that of some other key, so compare."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        h = self.hashes(keys)
        seed = self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = (_mixed(h, np.maximum(seed, 0)) % np.uint64(self.n)).astype(np.int64)
        return self.key_at[np.where(seed < 0, -seed - 1, slot)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is in the vocabulary.

    A part is known by its start; `end` is where it stops, which is the start of the next (0 once it is merged away).
    """
    n, get = len(piece), ranks.get
    end, before = [*range(1, n + 1), -1], list(range(-1, n))
    base = n + 1
    heap = [(r * base + i) * base + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        rest, stop = divmod(heappop(heap), base)
        i = rest % base
        mid = end[i]
        if not mid or end[mid] != stop:  # one of the two has changed since
            continue
        end[mid], end[i], before[stop] = 0, stop, i
        if stop < n and (r := get(piece[i : end[stop]])) is not None:
            heappush(heap, (r * base + i) * base + end[stop])
        k = before[i]
        if k >= 0 and (r := get(piece[k:stop])) is not None:
            heappush(heap, (r * base + k) * base + stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    """The number of each key, in order of first sight."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Tokenizer:
    """A vocabulary of byte strings by rank, and the pattern that cuts text into pre-tokens."""

    #: Distinct pre-tokens kept between documents; more empties the memory, which changes no result.
    KEPT = 600_000
    #: From this many characters on, pre-tokens are taken one by one, not as one list.
    LONG = 1_000_000

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        self.pattern, self.ranks = regex.compile(pattern), dict(zip(tokens, ids))
        self.tokens, self.ids = tokens, np.array(ids, np.int64)
        self.hash = PerfectHash(tokens)
        self.bytes_of: list[bytes | None] = [None] * (int(self.ids.max()) + 1 if ids else 0)
        for t, i in zip(tokens, ids):
            self.bytes_of[i] = t
        self.known: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> Tokenizer:
        """From a rank file: a base64 token and its rank in each line."""
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls([base64.b64decode(a) for a, _ in rows], [int(b) for _, b in rows], pattern)

    def _resolve(self, new: list[str]) -> list[bytes]:
        """Ids of each pre-token, packed as 32-bit integers."""
        raw = [x.encode() for x in new]
        out = []
        for k, i in zip(raw, self.hash.lookup(raw).tolist()):
            whole = self.tokens and self.tokens[i] == k
            ids = [int(self.ids[i])] if whole else merged(k, self.ranks)
            out.append(struct.pack(f"={len(ids)}i", *ids))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text."""
        number = _Numbers()
        codes = []
        for text in texts:
            text = text or ""
            found = (m.group() for m in self.pattern.finditer(text)) if len(text) > self.LONG else self.pattern.findall(text)
            codes.append(np.fromiter(map(number.__getitem__, found), np.int64))
        new = [t for t in number if t not in self.known]
        if len(self.known) + len(new) > self.KEPT:
            self.known, new = {}, list(number)
        self.known.update(zip(new, self._resolve(new)))
        packed = [self.known[t] for t in number]
        flat, size = np.frombuffer(b"".join(packed), np.int32), np.array([len(x) // 4 for x in packed], np.int64)
        start = np.cumsum(size) - size
        out = []
        for c in codes:
            n = size[c]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(start[c] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def __reduce__(self):
        return _again, (tuple(self.tokens), tuple(self.ids.tolist()), self.pattern.pattern)


@lru_cache(maxsize=4)
def _again(tokens: tuple[bytes, ...], ids: tuple[int, ...], pattern: str) -> Tokenizer:
    return Tokenizer(list(tokens), list(ids), pattern)


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, ids array<int>)` of every whole text, without special tokens."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    tok = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tok.value
        for b in pieces(batches, 500):
            ids = t.encode_all(b.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=["doc_id", "ids"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """`encoded` with the column `decoded`, the bytes of its ids."""
    tok = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tok.value
        for b in pieces(batches, 500):
            flat, ends = b.column(1).flatten().to_numpy(), np.cumsum(b.column(1).value_lengths().to_numpy())
            raw = [t.decode(x.tolist()) for x in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, ids binary, decoded binary)`: ids as little-endian unsigned 32-bit integers, as they are written to shards,
    and the bytes that they decode to. Encoding and decoding share a pass and the tables of one worker."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    tok = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tok.value
        for b in pieces(batches, 500, 8 << 20):
            ids = t.encode_all(b.column(1).to_pylist())
            raw = pa.array([t.decode(x.tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), raw], names=["doc_id", "ids", "decoded"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
