"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeats merge into intervals.

Map: each task hashes all windows of its documents (a rolling polynomial over word hashes, by prefix sums) and combines:
of a window that several of its documents hold, only the smallest document's is sent on; for the others the answer is
known. So one window, however common, is sent at most once per chunk of windows. Entries travel packed, dealt by hash range.
Reduce: each range finds the smallest document of each hash; entries of larger documents are hits. Hits meet by document,
where overlapping windows become maximal intervals, and only documents with hits are joined with their intervals.

Windows are compared by 64-bit hashes of 64-bit word hashes: of w distinct windows about w * w / 2 ** 65 pairs share one by
chance, none expected below 6e9 windows, 13 words in ten million at 1e13. Rows should come from a table (files), so that a task that is
run again gives the same rows.

Defined results: null text has no words; documents of fewer words than a window lose nothing; a null id counts as larger
than all others; rows that share an id are one document, whose windows are those of all of them and whose removed places
are removed from each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, as_bytes, packed, packed_apart, parts, pick, pieces, scratch, split_by_ids, stored, unpacked, unpacked_apart

#: Windows that a task combines before it sends them on: bounds its memory.
CHUNK = 1_500_000
_BASE, _LAST = 0x9E3779B97F4A7C15, 2**63 - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word. Faster than a memory of words, of which most occur once."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def window_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes, modulo 2^64: differences of prefix sums, scaled back."""
    n = len(word)
    if n < width:
        return np.empty(0, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = _powers(_room(n), _BASE)[:n], _powers(_room(n), inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up, dtype=np.uint64)])
    h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grouped(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of each group; group is sorted."""
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(group)).tolist()):
        if b > a:
            yield int(group[a]), [c[a:b] for c in columns]


def _hits(doc: np.ndarray, at: np.ndarray, groups: int, shift: int) -> tuple[list[int], list[bytes]]:
    """Hits packed by the group of their document."""
    g = ((doc.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(40)).astype(np.int64) % groups
    order = np.lexsort((at, doc, g))
    keys, blobs = [], []
    for k, (d, p) in _grouped(g[order], doc[order], at[order]):
        keys.append(k + shift)
        blobs.append(packed(np.diff(d, prepend=0), p))
    return keys, blobs


def _starts(ranges: int) -> np.ndarray:
    """The smallest hash of each range."""
    return np.array([-(-(r << 32) // ranges) << 32 for r in range(ranges)], np.uint64)


def _entries(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Entries of one range, in order of document and place, packed: what a hash has above the range's first, steps of
    documents, and steps of places within a document."""
    same = np.append(False, doc[1:] == doc[:-1])
    return packed_apart(h, np.diff(doc, prepend=0), np.where(same, np.diff(at, prepend=np.uint32(0)), at).astype(np.uint32))


def _read(data: bytes, start: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, step, at = unpacked_apart(data, np.uint64, np.int64, np.uint32)
    upto = np.cumsum(at.astype(np.int64))
    head = np.flatnonzero(np.append(True, step[1:] != 0))
    before = np.repeat((upto - at)[head], np.diff(np.append(head, len(at))))
    return h + start, np.cumsum(step), (upto - before).astype(np.uint32)


def _after_first(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries, sorted by hash and document, are of a larger document than the first of their hash."""
    head = np.append(True, h[1:] != h[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(h), dtype=np.int32), np.int32(0)))
    return doc > doc[first]


def _sent(ids: list[int], hashes: list[np.ndarray], ranges: int, groups: int) -> pa.RecordBatch:
    """What a chunk sends: entries by range of hashes, and the hits it knows of (keys from `ranges` on)."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    n = [len(hashes[i]) for i in order]
    doc = np.repeat(np.array([ids[i] for i in order], np.int64), n)
    at = np.concatenate([np.arange(k, dtype=np.uint32) for k in n])
    h = np.concatenate([hashes[i] for i in order])
    by = np.argsort(h, kind="stable").astype(np.int32)  # by hash, document, place
    known = np.zeros(len(h), bool)
    known[by[_after_first(h[by], doc[by])]] = True
    del by
    keys, blobs = _hits(doc[known], at[known], groups, ranges)
    h, doc, at = h[~known], doc[~known], at[~known]  # by document and place
    which = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(which, kind="stable")
    start = _starts(ranges)
    for k, (x, d, p) in _grouped(which[by], h[by], doc[by], at[by]):
        keys.append(k)
        blobs.append(_entries(x - start[k], d, p))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "data"])


def _without_copies(src: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The documents that aren't whole copies of a smaller one, and the spans of those that are: all their words.

    The smaller one holds every window of its copies, so these needn't send theirs; ids and hashes decide, and only texts
    that may be copies travel.
    """
    marks = stored(src.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")), "marks")
    least = marks.groupBy("h", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("h", "n", "least")
    copies = marks.join(least, ["h", "n"]).filter("doc_id > least").select("doc_id").distinct()
    one_text = marks.join(copies, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    copies = stored(one_text.filter(F.col("x").eqNullSafe(F.col("y"))).select("doc_id"), "copies")
    some, rest = split_by_ids(src, "doc_id", copies)
    words = F.regexp_count("text", F.lit(WORD))
    whole = some.join(copies, "doc_id", "left_semi").select("doc_id", words.cast("int").alias("w")).filter(F.col("w") >= width).distinct()
    spans = whole.select("doc_id", F.array(F.lit(0)).alias("starts"), F.array("w").alias("ends"))
    return rest.unionByName(some.join(copies, "doc_id", "left_anti")), spans


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, starts, ends)`: the maximal runs of words covered by windows that a smaller document also holds."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    src, whole = _without_copies(src, width)
    ranges, groups = parts(docs, 8), max(1, parts(docs) // 2)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held = [], [], 0
        for b in pieces(batches, 200):
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                words = text.split()
                if len(words) >= width:
                    ids.append(i)
                    hashes.append(window_hashes(word_hashes(words), width))
                    held += len(hashes[-1])
            if held >= CHUNK:
                yield _sent(ids, hashes, ranges, groups)
                ids, hashes, held = [], [], 0
        if ids:
            yield _sent(ids, hashes, ranges, groups)

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, data = key[0].as_py(), table.column("data").to_pylist()
        if k >= ranges:  # hits of chunks pass through
            return pa.table({"g": pa.array([k - ranges] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})
        start = _starts(ranges)[k]
        h, doc, at = map(np.concatenate, zip(*(_read(v, start) for v in data)))
        by = np.argsort(h, kind="stable")
        h, doc, at = h[by], doc[by], at[by]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(h))))
        keys, blobs = _hits(doc[doc > least], at[doc > least], groups, 0)
        return pa.table({"g": pa.array(keys, pa.int32()), "data": pa.array(blobs, pa.binary())})

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doc, at = map(np.concatenate, zip(*((np.cumsum(d), p.astype(np.int64)) for d, p in (unpacked(v, np.int64, np.uint32) for v in table.column("data").to_pylist()))))
        by = np.lexsort((at, doc))
        doc, at = doc[by], at[by]
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + width))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        of = doc[first]
        cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).astype(np.int32)
        as_lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32)))
        return pa.table({"doc_id": pa.array(of[cut[:-1]]), "starts": as_lists(at[first]), "ends": as_lists(at[last] + width)})

    sent = src.mapInArrow(windows, "key int, data binary")
    hits = sent.groupBy("key").applyInArrow(counted, "g int, data binary")
    return hits.groupBy("g").applyInArrow(merged, "doc_id bigint, starts array<int>, ends array<int>").unionByName(whole)


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_words, n_removed, kept)`: kept are the words outside the spans, joined by one blank."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col}).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    spans = spans.withColumnRenamed("doc_id", "key")
    some, none = split_by_ids(src, "key", spans.select("key"))
    empty = F.array().cast("array<int>")
    both = some.join(spans, "key", "left").select("doc_id", "text", "starts", "ends").unionByName(none.select("doc_id", "text", empty.alias("starts"), empty.alias("ends")))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500):
            n, gone, kept = [], [], []
            for text, starts, ends in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words, at, left = text.split(), 0, []
                for s, e in zip(starts or (), ends or ()):
                    left += words[at:s]
                    at = e
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`remove` of the `repeated_spans`, which are stored in between."""
    with scratch(docs.sparkSession):
        spans = stored(repeated_spans(docs, width, id_col, text_col), "spans")
    return remove(docs, spans, id_col, text_col)
