"""Document fingerprints (I-Match): terms of a middling document frequency, sorted, hashed over several random lexicons.

Terms are lower-cased words, hashed to 64 bits. Document frequencies are counted over all documents, term by term, in Spark.
The band takes terms in at least `least` of all documents (and in two) and at most `most`. Each term in it takes up that
share of documents, so there are at most (mean distinct terms of a document) / `least` of them however large the corpus:
that bounds the lexicon, the one table that every task gets. A fingerprint has one hash over
all terms in the band, eight over the lexicons that leave out a random eighth (few edits leave some of them equal), and for
each of five rates one over each of EACH small random lexicons, which split the terms of that rate: all terms of the band at
the first rate, a quarter, a sixteenth and so on. Of texts of few or many terms some rate has about one term in a lexicon,
and there lexicons agree in proportion to the terms shared. Parts have 32 bits.

`likeness` is the largest share, over these groups of lexicons, of equal non-empty parts among the parts that say something
about either text and PRIOR more, which hold down what few parts say; 1 for equal fingerprints. At NEAR (0.12) it finds 93 %
of texts of which one half was replaced, with 1.1 % of neighbours that are none (sf0.01; tests measure it).

The edited texts need each document's successor by descending id. Ids are range-partitioned by sampled splitters; each
range is sorted by itself and also gets the first document of the next range, one copy from each task that reads one like
it. The text moves once, compressed.

Defined results: null text is empty; equal texts have equal fingerprints; a text without terms in the band is hashed over
all its terms, or itself, and so is like its equals alone; null ids come last; rows that share an id follow each other,
ordered by a hash of the text; one row alone is its own successor; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_bytes, parts, pick, pieces

#: Rates as powers of two, lexicons of each, lexicons that leave out a part, parts that few are measured against, and the
#: likeness from which on texts count as near.
RATES, EACH, EIGHTHS, PRIOR, NEAR = (0, 2, 4, 6, 8), 32, 8, 2, 0.12
#: Terms of documents that a task counts before it sends them on.
CHUNK = 1_000_000
_MIN = -(2**63)


def terms(text: bytes) -> np.ndarray:
    """Distinct term hashes, sorted."""
    words = set(text.lower().split())
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`(term, df)`: in how many documents each term (by its hash) is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            h, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

        for b in pieces(batches, 500):
            for raw in as_bytes(b.column(0)):
                held.append(terms(raw))
                n += len(held[-1])
            if n >= CHUNK:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    return pick(docs, text=text_col).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def band(df: DataFrame, n: int, least: float = 1e-4, most: float = 0.05) -> np.ndarray:
    """The lexicon, sorted hashes of the terms that count, of a corpus of n documents. least and most are shares of it."""
    low = max(2, int(np.ceil(least * n)))
    got = df.filter((F.col("df") >= low) & (F.col("df") <= max(low, most * n))).select("term").toPandas()  # mean terms / least rows at most
    return np.sort(got["term"].to_numpy(np.int64).view(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def parts_of(text: bytes, lexicon: np.ndarray) -> np.ndarray:
    """The parts of a fingerprint as integers; 0 marks a part of which the text has no term. lexicon: sorted hashes."""
    every = terms(text)
    at = np.searchsorted(lexicon, every)
    h = every[lexicon[np.minimum(at, len(lexicon) - 1)] == every] if len(lexicon) else every[:0]
    if not len(h):
        h = every if len(every) else np.array([xxhash.xxh3_64_intdigest(text)], np.uint64)
    z = _mixed(h)
    c = _mixed(z)
    eighth = np.zeros(EIGHTHS, np.uint64)
    np.add.at(eighth, (c >> np.uint64(61)).astype(np.int64), z)
    whole = z.sum(dtype=np.uint64)
    small = np.zeros(len(RATES) * EACH, np.uint64)
    u = _mixed(c)
    for k, rate in enumerate(RATES):  # rates ascend, so each takes its terms from those of the one before
        cell = u >> np.uint64(64 - EACH.bit_length() + 1 - rate)
        m = cell < EACH
        z, u = z[m], u[m]
        np.add.at(small, cell[m].astype(np.int64) + k * EACH, z)
    out = np.concatenate([[whole], whole - eighth, small])
    return np.where(out == 0, np.uint64(0), np.maximum(_mixed(out) >> np.uint64(32), np.uint64(1)))


def written(p: np.ndarray) -> str:
    return p.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    best, at = 0.0, 0
    for size in (1 + EIGHTHS, *[EACH] * len(RATES)):
        x, y = a[at : at + size], b[at : at + size]
        at += size
        told = int(((x > 0) | (y > 0)).sum())
        best = max(best, int(((x == y) & (x > 0)).sum()) / (told + PRIOR))
    return best


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, text, next_text)`: the text that follows by descending id; after the last, the first."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = parts(docs)
    order = F.xxhash64("text")
    marks = src.select(F.coalesce("doc_id", F.lit(_MIN)).alias("id"), order.alias("h"))
    cuts = sorted(set(marks.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)), reverse=True) if n > 1 else []
    edges = -np.array(cuts, np.float64)  # range k: ids from above cuts[k] to at most cuts[k - 1]

    def range_of(i: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, -i.astype(np.float64), side="right")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        for b in batches:
            i, h = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            k = range_of(i)
            by = np.lexsort((h, -i.astype(np.float64), k))
            for j in by[np.append(True, k[by][1:] != k[by][:-1])[: len(by)]].tolist():
                mine = (-int(i[j]), int(h[j]))
                first[int(k[j])] = min(first.get(int(k[j]), mine), mine)
        yield pa.RecordBatch.from_pydict({"k": pa.array(first, pa.int32()), "id": pa.array([-x for x, _ in first.values()], pa.int64()), "h": pa.array([x for _, x in first.values()], pa.int64())})

    top = marks.mapInArrow(heads, "k int, id bigint, h bigint").groupBy("k").agg(F.min(F.struct((-F.col("id").cast("decimal(20,0)")).alias("x"), "h", "id")).alias("top"))
    head = {r.k: (r.top.id, r.top.h) for r in top.collect()}  # a row for each range
    order_of = sorted(head)
    before = {head[k]: order_of[i - 1] for i, k in enumerate(order_of)}  # the head of a range also goes to the range before it

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            i, h = b.column(0).fill_null(_MIN).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            extra = []
            for r, mark in enumerate(zip(i.tolist(), h.tolist())):
                if (to := before.get(mark)) is not None and to not in sent:
                    sent.add(to)
                    extra.append((r, to))
            take = pa.array(np.concatenate([np.arange(len(i)), np.array([r for r, _ in extra], np.int64)]))
            k = np.concatenate([range_of(i), np.array([to for _, to in extra], np.int64)]).astype(np.int32)
            tail = np.arange(len(k)) >= len(i)
            text = pa.array([squeeze(x) for x in as_bytes(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(tail), b.column(0).take(take), text.take(take), b.column(2).take(take)], names=["k", "tail", "doc_id", "text", "h"])

    rows = src.withColumn("h", order).mapInArrow(dealt, "k int, tail boolean, doc_id bigint, text binary, h bigint")
    rows = rows.repartitionById(len(edges) + 1, F.col("k")).sortWithinPartitions("k", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        spread = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches, 500, 4 << 20):
            out = []
            for k, tail, i, raw in zip(*(c.to_pylist() for c in b.columns)):
                text = spread(raw).decode()
                if held and held[0] == k and not held[1]:
                    out.append((held[2], held[3], text))
                held = (k, tail, i, text)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "next_text"])

    return rows.mapInArrow(follow, "doc_id bigint, text string, next_text string")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(pairs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """For `(doc_id, text, next_text)`: n_chars, the edited text, fingerprints of all three and their likeness."""
    sent = pairs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        last: tuple[str, np.ndarray] | None = None
        for b in pieces(batches, 500):
            cols: list[list] = [[], [], [], [], [], []]
            for text, following in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = last[1] if last and last[0] == text else parts_of(text.encode(), lexicon)
                last = (following, parts_of(following.encode(), lexicon))
                new = edited(text, following)
                other = parts_of(new.encode(), lexicon)
                for c, v in zip(cols, (len(text), new, written(own), written(other), likeness(own, other), likeness(own, last[1]))):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return pairs.mapInArrow(run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
