"""Quality rules: repetition from each text's suffix array over words.

The words of a batch of texts form one array; suffixes are ranked by prefix doubling, where the first key holds the text,
so that suffixes of different texts never tie and only suffixes that still tie within their text are sorted further. The
longest common prefixes of neighbours in suffix order come from the ranks of all levels. A run of neighbours that share at
least l words, with l itself among their prefixes, is an LCP interval: a substring of l words and all its places. Where the
words before these places differ, the repeat is maximal (it can't grow on either side). Intervals of `min_repeat` words are
enumerated with a stack; the union of their spans gives the covered fraction, the longest maximal one the longest repeat.
These two are limited, and nothing else is part of the verdict. `fit` finds both limits from labelled documents.

`few_symbols` is a rule of its own, for those who also want texts with many symbols out; `keep` applies it on request.

One Python pass per Arrow batch; no shuffle. A step ranks STEP bytes of text or one text: for n words that takes about
8 * n * log2(longest repeat) bytes.

Defined results: null and empty text have no words and fail the base rule; texts are judged each by itself, so repeated
rows are all judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_bytes, numbered, pick, pieces

#: Bytes of text that are ranked at once (one text at least).
STEP = 4 << 20
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Shortest repeat that counts (words), largest covered fraction, and longest repeat as a fraction of the words.

    The fractions come from `fit` on the table `labels` at sf0.1, rounded up to the next 1/16 and 1/32.
    """

    min_repeat: int = 8
    max_covered: float = 0.25
    max_longest: float = 0.125


def neighbours(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word occurs again in their text, in suffix order, and the words that each shares with the one before
    it (0 for the first, and where texts or first words differ).

    word: ids of words, text: number of the text of each word (ascending).
    """
    n = len(word)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    head = np.append(True, np.diff(key[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    stop = np.searchsorted(text, text, side="right")  # where the text ends
    levels, step = [rank], 1
    tied = order[~(head & np.append(head[1:], True))]  # in suffix order; suffixes that are alone are placed
    ties = tied
    while len(tied):
        far = tied + step
        inside = far < stop[tied]
        second = np.where(inside, rank[np.where(inside, far, 0)], -1)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        old = rank[tied]
        old_head = np.append(True, np.diff(old) != 0)
        new_head = old_head | np.append(True, np.diff(second) != 0)
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(new_head, at, 0)) - np.maximum.accumulate(np.where(old_head, at, 0))
        levels.append(rank)
        step *= 2
        tied = tied[~(new_head & np.append(new_head[1:], True))]
    if not len(ties):
        return none, none
    seq = ties[np.argsort(rank[ties], kind="stable")]
    a, b = seq[:-1], seq[1:]
    same = levels[0][a] == levels[0][b]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = same & (x + (1 << k) <= stop[a]) & (y + (1 << k) <= stop[b])
        x, y = np.where(ok, x, a), np.where(ok, y, b)
        lcp += (ok & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return seq, np.append(0, lcp)


_DIVERSE = -2


def lcp_intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, maximal) of each LCP interval of `least` words: the suffixes first to last share just so many.

    lcp[k]: words that suffix k shares with suffix k - 1; left[k]: the word before suffix k, or _DIVERSE at a text's start.
    An interval is maximal if the words before its suffixes aren't all equal.
    """
    stack: list[list[int]] = []  # length, first suffix, the word before all of them so far

    def closed(upto: int, last: int, word: int, first: int) -> Iterator[tuple[int, int, int, bool]]:
        """Closes intervals longer than `upto` at suffix `last`; then suffixes from `first` on belong to the next."""
        while stack and stack[-1][0] > upto:
            top = stack.pop()
            top[2] = top[2] if top[2] == word else _DIVERSE
            yield top[0], top[1], last, top[2] == _DIVERSE
            word, first = top[2], top[1]
        if stack and stack[-1][0] == upto:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == word else _DIVERSE
        elif upto >= least:
            stack.append([upto, first, word])

    before = -1
    for k in np.flatnonzero(lcp >= least).tolist():
        if stack and k != before + 1:
            yield from closed(0, before, int(left[before]), before)
        yield from closed(int(lcp[k]), k - 1, int(left[k - 1]), k - 1)
        before = k
    if stack:
        yield from closed(0, before, int(left[before]), before)


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _judged(raw: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    number: dict[bytes, int] = {}
    ids, symbols, chars, lines = [], [], [], []
    for text in raw:
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in text.split()), np.int64))
        symbols.append(len(text) - len(text.translate(None, _SYMBOLS)))
        chars.append(len(text.translate(None, _SPACE + _INNER)))
        with_word = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(with_word) - len(set(with_word)))
    n = np.array([len(x) for x in ids], np.int64)
    word, of = np.concatenate([*ids, np.empty(0, np.int64)]), np.repeat(np.arange(len(ids)), n)
    seq, shared = neighbours(word, of)
    lcp = np.zeros(len(word), np.int64)  # of each place the length of the innermost interval that it is in
    lcp[seq] = np.maximum(shared, np.append(shared[1:], 0)[: len(shared)])
    sums = lambda mask: np.bincount(of[mask], minlength=len(ids))
    three = np.flatnonzero(lcp >= 3)
    long = np.flatnonzero(lcp >= limits.min_repeat)
    starts = np.append(True, of[1:] != of[:-1])[: len(of)]
    left = np.where(starts[seq], _DIVERSE, word[seq - 1])
    longest, repeats = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for length, first, _, maximal in lcp_intervals(shared, left, limits.min_repeat):
        if maximal:
            t = of[seq[first]]
            repeats[t] += 1
            longest[t] = max(longest[t], length)
    return {
        "n_words": n, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": sums(covered(three, np.full(len(three), 3), len(word))), "n_covered": sums(covered(long, lcp[long], len(word))), "longest_repeat": longest, "n_repeats": repeats,
    }


def measure(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text, `base_failed` and `kept`."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500, STEP):
            got = _judged(as_bytes(b.column(1)), limits)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k], pa.int64()) for k in names)], names=["doc_id", *names])

    return verdict(src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in names)), limits)


def passes(counts, limits: Limits):
    """Whether the method lets a text pass; counts: columns, or arrays, by name."""
    n = counts["n_words"]
    return (counts["n_covered"] <= limits.max_covered * n) & (counts["longest_repeat"] <= limits.max_longest * n)


def few_symbols(counts, most: float):
    """Another rule: at most so many symbols for each word; counts as above."""
    return counts["n_symbols"] <= most * counts["n_words"]


def fails(counts):
    """Whether a text fails the base rule; counts as above."""
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def verdict(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`counts` with `base_failed` and `kept`."""
    return counts.withColumn("base_failed", fails(counts)).withColumn("kept", ~F.col("base_failed") & passes(counts, limits))


def fit(counts: DataFrame, labels: DataFrame, share: float = 0.002, min_repeat: int = 8) -> Limits:
    """Limits above either of which at most `share` of the good documents lie that pass the base rule.

    counts: doc_id and the counts of `measure`; labels: doc_id, quality (1: good). Exact percentiles, in Spark.
    """
    good = counts.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").filter(~F.col("base_failed"))
    part = [F.percentile(F.col(c) / F.col("n_words"), F.lit(1 - share)).alias(c) for c in ("n_covered", "longest_repeat")]
    x = good.agg(*part).first()
    return Limits(min_repeat, x.n_covered or 0.0, x.longest_repeat or 0.0)


def keep(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", max_symbols: float | None = None) -> DataFrame:
    """The rows of `docs` whose text (the first column of that name) passes, with their columns as they were, whatever their
    names. max_symbols: also apply `few_symbols`."""
    at = docs.columns.index(text_col)
    flat = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500, STEP):
            got = _judged(as_bytes(b.column(at)), limits)
            fine = ~fails(got) & passes(got, limits)
            yield b.filter(pa.array(fine if max_symbols is None else fine & few_symbols(got, max_symbols)))

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)
