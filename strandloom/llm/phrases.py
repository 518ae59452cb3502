"""Phrase collocations by stripes: each prefix keys a counter of its next words; stripes of all tasks merge elementwise.

Level by level: the empty prefix's stripe counts words, prefixes of one to three words give phrases of two to four. A task
counts a chunk of text in stripes and sends those of a bucket together (prefixes, lengths of their stripes, next words,
counts); a bucket merges them by adding equal entries. Buckets go by prefix and PIECES classes of the next word, so a very
common prefix is spread over many. From the merged stripes come the extensions of a prefix, the totals of the phrases that
they are, and for each phrase the largest count of a phrase that extends it to the right or to the left.

A phrase of `least` occurrences has parts of at least as many. So level m counts a phrase only where both its parts of m - 1
words may be frequent, which a bit filter of these tells (`common.filter_bits`: 128 MB at most). A fuller filter lets more
through, which the merged counts drop: results are exact. All counts of parts come along from level to level, so that a cut
needs no search.

Words are known by 64-bit hashes with their language as seed; of w distinct words w * w / 2^65 pairs share one by chance,
about 0.03 at 10^9 words. Text should come from a table, so that a task that runs again gives the same rows.

Defined results: null text is empty, null language `und`; repeated rows count again; texts without words give nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import as_bytes, bit_filter, filter_bits, packed, parts, pick, pieces, stored, unpacked

#: Words that a task counts before it sends them; classes of next words.
CHUNK, PIECES = 2_000_000, 256
_CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with a line end wherever a piece ends; some are empty."""
    return text.lower().translate(_CUTS).replace(b"\n", b" \n ").split(b" ")


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    return (x ^ (x >> np.uint64(29))) * _MIX


def _key(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each run of words; of a single word the word's own."""
    out = words[0]
    for w in words[1:]:
        out = _mixed(out) + w
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """`(lang, word, w1, c)`: occurrences of each word (w1: its hash) in documents `(text, lang)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[bytes]] = defaultdict(Counter)
        n = 0

        def sent() -> pa.RecordBatch:
            langs, words, hashes, counts = [], [], [], []
            for lang, counter in held.items():
                for x in (b"", _END):
                    counter.pop(x, None)
                langs += [lang] * len(counter)
                words += counter
                hashes += map(xxhash.xxh3_64_intdigest, counter, repeat(_seed(lang)))
                counts += counter.values()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "word", "w1", "c"])

        for b in pieces(batches, 500):
            for raw, lang in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                words = words_of(raw)
                held["und" if lang is None else lang].update(words)
                n += len(words)
            if n >= CHUNK:
                yield sent()
                held.clear()
                n = 0
        if n:
            yield sent()

    return docs.mapInArrow(run, "lang string, word string, w1 bigint, c bigint").groupBy("lang", "word", "w1").agg(F.sum("c").alias("c"))


def known_phrases(phrases: DataFrame, m: int) -> np.ndarray:
    """Bits, in bytes, of the phrases `(w1 .. wm)`: the bit that their key's upper bits name is set."""
    bits = filter_bits(phrases.count())

    @F.pandas_udf("long")
    def place(*words: pd.Series) -> pd.Series:
        return pd.Series((_mixed(_key([w.to_numpy(np.int64).view(np.uint64) for w in words])) >> np.uint64(64 - bits)).astype(np.int64))

    return bit_filter(phrases.select(place(*[f"w{k}" for k in range(1, m + 1)])), bits)


def _told(bits: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Whether the filter may hold each run of words."""
    at = _mixed(_key(words)) >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stripes(words: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Occurrences of phrases counted in stripes, a row for each bucket."""
    *prefix, following = words
    key = _key(prefix)
    bucket = (_mixed(key + (following & np.uint64(PIECES - 1)) * _MIX) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((following, key, bucket))
    bucket, key, following = bucket[by], key[by], following[by]
    entry = _heads(bucket, key, following)
    counts = np.diff(np.append(entry, len(by))).astype(np.uint32)
    bucket, key, following, first = bucket[entry], key[entry], following[entry], by[entry]
    stripe = _heads(bucket, key)
    lengths = np.diff(np.append(stripe, len(entry))).astype(np.uint32)
    prefixes = [p[first[stripe]] for p in prefix]
    of = bucket[stripe]
    cut = np.append(_heads(of), len(of))
    keys, left, right = [], [], []
    edges = np.append(stripe, len(entry))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        keys.append(int(of[a]))
        left.append(packed(*[p[a:b] for p in prefixes], lengths[a:b]))
        right.append(packed(following[edges[a] : edges[b]], counts[edges[a] : edges[b]]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["bucket", "prefixes", "entries"])


def extensions(docs: DataFrame, m: int, known: np.ndarray, least: int) -> DataFrame:
    """`(w1 .. wm, c)`: phrases of m words with at least `least` occurrences. known: the filter of those of m - 1 words."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(known), parts(docs, 4)

    def candidates(raw: bytes, lang: str | None, bits: np.ndarray) -> list[np.ndarray]:
        words = words_of(raw)
        seed = _seed("und" if lang is None else lang)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))
        empty, stop = (np.uint64(xxhash.xxh3_64_intdigest(x, seed)) for x in (b"", _END))
        h = h[h != empty]
        free = h != stop
        n = len(h) - m + 1
        if n < 1:
            return [h[:0]] * m
        whole = np.logical_and.reduce([free[k : n + k] for k in range(m)])
        part = _told(bits, [h[k : len(h) - m + 2 + k] for k in range(m - 1)])
        at = np.flatnonzero(whole & part[:-1] & part[1:])
        return [h[at + k] for k in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = sent.value, [], 0
        for b in pieces(batches, 500):
            for raw, lang in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                held.append(candidates(raw, lang, bits))
                n += len(held[-1][0])
            if n >= CHUNK:
                yield _stripes([np.concatenate(x) for x in zip(*held)], buckets)
                held, n = [], 0
        if n:
            yield _stripes([np.concatenate(x) for x in zip(*held)], buckets)

    names = [f"w{k}" for k in range(1, m + 1)]

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = []
        for left, right in zip(table.column("prefixes").to_pylist(), table.column("entries").to_pylist()):
            *prefix, lengths = unpacked(left, *[np.uint64] * (m - 1), np.uint32)
            got.append([*(np.repeat(p, lengths) for p in prefix), *unpacked(right, np.uint64, np.uint32)])
        *words, counts = (np.concatenate(x) for x in zip(*got))
        by = np.lexsort(words[::-1])
        words, counts = [w[by] for w in words], counts[by].astype(np.int64)
        entry = _heads(*words)
        total = np.add.reduceat(counts, entry)
        keep = total >= least
        return pa.table({**{n: pa.array(w[entry][keep].view(np.int64)) for n, w in zip(names, words)}, "c": pa.array(total[keep])})

    sent_rows = docs.mapInArrow(run, "bucket int, prefixes binary, entries binary")
    return sent_rows.groupBy("bucket").applyInArrow(merged, ", ".join(f"{n} bigint" for n in names) + ", c bigint")


def _joined(found: DataFrame, shorter: DataFrame, m: int) -> DataFrame:
    """Phrases of m words with their language, text, last word, and counts of their first and last k words, k from 1 to m."""
    shared = [f"w{k}" for k in range(2, m)]
    front = shorter.select(*[f"w{k}" for k in range(1, m)], "lang", F.col("phrase").alias("front"), F.col("heads").alias("front_heads"))
    back = shorter.select(*[F.col(f"w{k - 1}").alias(f"w{k}") for k in range(2, m + 1)], "last", F.col("tails").alias("back_tails"))
    both = found.join(front, [*["w1"], *shared]).join(back, [*shared, f"w{m}"])
    phrase = F.concat_ws(" ", "front", "last").alias("phrase")
    heads, tails = (F.array_append(x, F.col("c")).alias(y) for x, y in (("front_heads", "heads"), ("back_tails", "tails")))
    return both.select(*[f"w{k}" for k in range(1, m + 1)], "lang", phrase, "last", "c", heads, tails)


def best_cut(m: int) -> Column:
    """The cut of lowest score, then smallest k, as a struct (score, k, l, r)."""
    a = F.col("c").cast("decimal(20,0)")
    cuts = []
    for k in range(1, m):
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(m - k - 1))  # noqa: E741
        score = F.call_function("div", a * F.lit(2_000_000).cast("decimal(7,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def top(scored: DataFrame, most: int, salts: int) -> DataFrame:
    """The first `most` rows of each language with their rank: first within classes of phrases, then among these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    few = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("_in", within).filter(F.col("_in") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most).drop("_salt", "_in")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, longest: int = 4, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's phrases of two to `longest` words: lang, rank, phrase, a, l, r, n, score (see `best_cut`).

    Phrases need `least` occurrences; one that a longer such phrase holds with at least `percent` per cent of them is left out.
    """
    src = pick(docs, text=text_col, lang=lang_col)
    words = stored(word_counts(src), "words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    one = F.array("c")
    levels = [stored(words.filter(F.col("c") >= least).select("w1", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "c", one.alias("heads"), one.alias("tails")), "level1")]
    for m in range(2, longest + 1):
        known = known_phrases(levels[-1].select(*[f"w{k}" for k in range(1, m)]), m - 1)
        found = stored(extensions(src, m, known, least), f"found{m}")
        levels.append(stored(_joined(found, levels[-1], m), f"level{m}"))
    kept = []
    for m, level in enumerate(levels[1:], 2):
        if m < longest:
            names, longer = [f"w{k}" for k in range(1, m + 1)], levels[m]
            right = longer.select(*names, "c")
            left = longer.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, m + 1)], "c")
            largest = right.unionByName(left).groupBy(*names).agg(F.max("c").alias("longer"))
            level = level.join(largest, names, "left").filter(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("c").cast("decimal(20,0)") * percent, F.lit(True)))
        kept.append(level.select("lang", "phrase", F.col("c").alias("a"), best_cut(m).alias("cut")))
    every = kept[0]
    for x in kept[1:]:
        every = every.unionByName(x)
    scored = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    return top(scored, most, min(parts(docs), 1024)).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
