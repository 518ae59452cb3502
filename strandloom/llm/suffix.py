"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else.

Sorting every suffix of a corpus is out of reach, so suffixes are sampled by content. The anchor of a window of `length`
bytes is the place of the smallest hashed 8-gram in its first REACH places; equal windows have equal anchors at equal
offsets, and each window has just one. Only suffixes at anchors are handled.

1. Anchors whose lead (the bytes that all windows of an anchor share) occurs once drop out, by a counting aggregate.
2. The others become contexts: bytes to the right as far as their windows reach, and to the left, reversed. A task sends a
   context that it has seen before no second time. Sampled splitters range-partition contexts by lead.
3. Each bucket, sorted by lead, goes through in batches that end between leads. Contexts are sorted by a multikey sort (eight
   bytes at a time, only ties go on) to the right and to the left; neighbours' common prefixes give classes of equal
   prefixes at each depth. The window at offset j is a repeat if another context shares its class to the right at depth
   length - j and to the left at depth j. Leads never straddle buckets, so no comparison crosses a boundary.
4. A lead with more than HOT anchors (a licence header with thousands of continuations) would be too much for one task. Its
   windows are told apart by two 64-bit polynomial hashes of all `length` bytes instead: a task combines equal windows of
   its texts and sends each once, and a plain aggregate finds those that several tasks sent.
5. Repeats become byte spans, joined with the texts that have any.

Defined results: null text is empty; texts shorter than `length` lose nothing; rows are told apart by a 64-bit hash of id
and text, equal rows count as occurrences of each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SHARE, as_bytes, parts, pick, pieces, scratch, split_by_ids, spread_join, stored
from strandloom.llm.windows import window_hashes

GRAM, REACH = 8, 256
#: Windows handled at once, contexts sorted at once, contexts that a task remembers, anchors of a lead for one task.
STRETCH, BATCH, SEEN, HOT = 1 << 22, 20_000, 300_000, 20_000
FIELDS = ["key", "at", "low", "high", "right", "left", "known"]
#: Two random values for each byte, for hashes of windows.
_VALUES = np.random.default_rng(17).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and last start of the windows that each serves."""
    n = len(text) - length + 1
    out = []
    for a in range(0, n, STRETCH):
        m = min(STRETCH, n - a)
        v = np.ndarray((m + REACH - 1,), "<u8", text, offset=a, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v &= np.uint64(~((1 << 24) - 1) & (2**64 - 1))
        v |= np.arange(len(v), dtype=np.uint64)
        step = 1
        while step < REACH:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        at = (v & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((at[first] + a, first + a, np.append(first[1:], m) - 1 + a))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def multikey(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows (all of one width): sorts by eight bytes at a time; only rows that still tie go on."""
    n = len(rows)
    width = -(-rows.shape[1] // 8) * 8
    words = np.zeros((n, width), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8")
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of the place in order
    for d in range(1, words.shape[1]):
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        by = np.lexsort((words[order[at], d], rank[at]))
        order[at] = order[at][by]
        key, old = words[order[at], d].astype(np.uint64), rank[at]
        head = np.append(True, (key[1:] != key[:-1]) | (old[1:] != old[:-1]))
        new[at] |= head
        rank = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte rows, and how many bytes each shares with the one before it."""
    order = multikey(rows)
    x = rows[order]
    differ = x[1:] != x[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.append(0, shared)


def _matrix(values: list[bytes]) -> np.ndarray:
    width = max(1, max(map(len, values)))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def repeats(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of offsets whose windows occur in more than one context: context, first offset, last offset.

    low, high: the offsets of each context's windows; right and left reach as far as these need.
    """
    n = len(right)
    r_order, r_shared = classes(_matrix(right))
    l_order, l_shared = classes(_matrix(left))
    top = int(high.max()) + 1
    hit = np.zeros((n, top), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    near = np.maximum(r_shared, np.append(r_shared[1:], 0))
    hopeful = np.zeros(n, bool)
    hopeful[r_order] = near >= length - high[r_order]
    for j in range(int(low.min()), top):
        act = np.flatnonzero((low <= j) & (high >= j) & hopeful)
        if len(act) < 2:
            continue
        r_class[r_order] = np.cumsum(r_shared < length - j)
        l_class[l_order] = np.cumsum(l_shared < j)
        key = r_class[act] * (n + 1) + l_class[act]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit[act[by], j] = np.append(False, same) | np.append(same, False)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return who, start, stop - 1


def _window_pairs(text: bytes, length: int) -> np.ndarray:
    """16 bytes of hash of the window at each place."""
    b = np.frombuffer(text, np.uint8)
    return np.column_stack([window_hashes(v[b], length) for v in _VALUES]).view("V16").ravel()


def _combined(common: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of the windows `(key, starts, hashes)` of a batch of texts: those of equal hash are repeats and become runs; each hash
    goes on once, to be compared with other batches. Gives rows of contexts: left is null where right is a window's hash."""
    key = np.repeat(np.array([k for k, _, _ in common], np.int64), [len(s) for _, s, _ in common])
    st, h = np.concatenate([s for _, s, _ in common]), np.concatenate([x for _, _, x in common])
    word = h.view(np.uint64).reshape(-1, 2)
    by = np.lexsort((word[:, 1], word[:, 0]))
    head = np.append(True, (word[by][1:] != word[by][:-1]).any(axis=1))
    twice = ~(head & np.append(head[1:], True))
    known = np.zeros(len(key), bool)
    known[by[twice]] = True
    once = by[head]
    none, zero = pa.nulls(len(once), pa.binary()), pa.array(np.zeros(len(once), np.int32))
    hashes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(once), [None, pa.py_buffer(np.ascontiguousarray(h[once]).tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(key[once]), pa.array(st[once]), zero, zero, hashes.cast(pa.binary()), none, pa.array(known[once])], names=FIELDS)
    k, p = key[known], st[known]
    if len(k):
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)))
        last = p[np.append(new[1:], len(k)) - 1]
        spread = [xxhash.xxh3_128_digest(x.tobytes()) for x in np.column_stack([k[new], last])]
        n = len(new)
        yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(last), pa.array(np.zeros(n, np.int32)), pa.array((last - p[new]).astype(np.int32)), pa.array(spread, pa.binary()), pa.array([b""] * n, pa.binary()), pa.array(np.ones(n, bool))], names=FIELDS)


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """`(key, spans array<struct<st, ed>>)` of rows with repeats; key is that of `keyed`. hot: anchors of a lead that one task
    takes at most."""
    if length < REACH + GRAM:
        raise ValueError(f"length must be at least {REACH + GRAM}")
    src = keyed(docs, id_col, text_col).select("key", "text")
    lead = length - REACH + 1

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500):
            keys, found = [], []
            for k, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                at = anchors(text, length)[0].tolist()
                keys += [k] * len(at)
                found += [xxhash.xxh3_64_intdigest(text[p : p + lead]) for p in at]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "lead"])

    places = stored(src.mapInArrow(leads, "key bigint, lead bigint"), "leads")
    often = stored(places.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("hot", F.col("n") > hot), "often")
    # leads that hold much of all anchors, SHARE of them at most, are found without a shuffle
    common = F.broadcast(often.filter(F.col("n") > max(places.count() // SHARE, hot)).select("lead", "hot"))
    found = places.join(common, "lead").unionByName(places.join(common, "lead", "left_anti").join(often.select("lead", "hot"), "lead"))
    wanted = stored(found.groupBy("key").agg(F.collect_set(F.struct("lead", "hot")).alias("leads")), "wanted")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple | None] = {}
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
        for b in pieces(batches, 100, 1 << 20):
            out: list[tuple] = []
            common: list[tuple[int, np.ndarray, np.ndarray]] = []

            def known(row: tuple) -> None:  # its windows are repeats, and it needs no bucket of its own
                out.append((*row, xxhash.xxh3_128_digest(repr(row).encode()), b"", True))

            for k, text, mine in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()):
                is_hot = {x["lead"]: x["hot"] for x in mine}
                starts: list[np.ndarray] = []
                for p, first, last in zip(*(x.tolist() for x in anchors(text, length))):
                    how = is_hot.get(int(np.uint64(xxhash.xxh3_64_intdigest(text[p : p + lead])).view(np.int64)))
                    if how is None:
                        continue
                    if how:
                        starts.append(np.arange(first, last + 1))
                        continue
                    low, high = p - last, p - first
                    row, right, left = (k, p, low, high), text[p : p + length - low], text[first:p][::-1]
                    mark = xxhash.xxh3_128_digest(left + bytes([low, high]) + right)
                    if mark in seen:
                        known(row)
                        if before := seen[mark]:
                            known(before)
                            seen[mark] = None
                    else:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen[mark] = row
                        out.append((*row, right, left, False))
                if starts:
                    st = np.concatenate(starts)
                    common.append((k, st, _window_pairs(text, length)[st]))
            if common:
                yield from _combined(common)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=FIELDS)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[tuple]) -> pa.RecordBatch:
            sure = [r for r in rows if r[6]]
            rows = [r for r in rows if not r[6]]
            key, at, low, high = ([r[j] for r in sure] for j in range(4))
            st, ed = [p - h for p, h in zip(at, high)], [p - j + length for p, j in zip(at, low)]
            if len(rows) > 1:
                low, high = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
                who, first, last = repeats([r[4] for r in rows], [r[5] for r in rows], low, high, length)
                p = np.array([r[1] for r in rows], np.int64)[who]
                key += [rows[i][0] for i in who.tolist()]
                st += (p - last).tolist()
                ed += (p - first + length).tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, st, ed)], names=["key", "st", "ed"])

        held: list[tuple] = []
        for b in pieces(batches, BATCH):
            held += zip(*(c.to_pylist() for c in b.columns))
            if len(held) >= BATCH:
                end = len(held) - 1  # where the last lead begins
                while end and held[end - 1][4][:lead] == held[-1][4][:lead]:
                    end -= 1
                if end:
                    yield judged(held[:end])
                    held = held[end:]
        yield judged(held)

    some, _ = split_by_ids(src, "key", wanted.select("key"))
    rows = stored(some.join(wanted, "key").mapInArrow(contexts, "key bigint, at bigint, low int, high int, right binary, left binary, known boolean"), "contexts")
    by = F.substring("right", 1, lead)
    dealt = rows.filter("left is not null").repartitionByRange(parts(docs), by).sortWithinPartitions(by)
    spans = dealt.mapInArrow(bucket, "key bigint, st bigint, ed bigint")
    windows = rows.filter("left is null").select("right", "key", F.col("at").alias("st"), (F.col("at") + length).alias("ed"), "known")
    twice = windows.groupBy("right").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("right")
    again = spread_join(windows.filter("not known"), twice, "right", F.col("key"), "left_semi")  # one window may be in very many texts
    spans = spans.unionByName(again.select("key", "st", "ed"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("st", "ed"))).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`(doc_id, text, key)`: key tells rows apart."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    return src.withColumn("key", F.xxhash64("doc_id", "text"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept)`: kept are the bytes outside the spans."""
    src = keyed(docs, id_col, text_col)
    some, none = split_by_ids(src, "key", spans.select("key"))
    empty = F.array().cast("array<struct<st: bigint, ed: bigint>>").alias("spans")
    both = some.join(spans, "key", "left").select("doc_id", "text", "spans").unionByName(none.select("doc_id", "text", empty))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500):
            n, gone, count, kept = [], [], [], []
            for text, spans in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                left, at, runs = [], 0, 0
                for s in spans or ():
                    if s["st"] > at or not runs:
                        left.append(text[at : s["st"]])
                        runs += 1
                    at = max(at, s["ed"])
                left.append(text[at:])
                kept.append(b"".join(left))
                n.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                count.append(runs)
            arrays = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """`remove` of the `repeated_spans`, which are stored in between."""
    with scratch(docs.sparkSession):
        spans = stored(repeated_spans(docs, length, id_col, text_col, hot), "spans")
    return remove(docs, spans, id_col, text_col)
