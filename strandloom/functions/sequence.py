"""Column functions on nucleotide strings and annotation texts. All but those that compare all k-mers of a text stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(s: Column | str) -> Column:
    """Reverse complement; letters other than ACGT (either case) stay."""
    return F.translate(F.reverse(_col(s)), "ACGTacgt", "TGCATGCA")


def collapse(s: Column | str) -> Column:
    """Each run of one letter becomes one letter."""
    return F.regexp_replace(_col(s), r"(.)\1+", "$1")


def collapsed_length(s: Column | str) -> Column:
    return F.length(collapse(s))


def is_complex(s: Column | str, least: int = 8) -> Column:
    """Whether enough is left when homopolymers are collapsed."""
    return collapsed_length(s) >= least


def homopolymer_equal(a: Column | str, b: Column | str) -> Column:
    return collapse(a) == collapse(b)


#: Places of a string that are cut out at once: a substring is found by walking there from the string's start.
_STRIDE = 512


def kmers(s: Column | str, k: Column | int, skip_n: bool = True) -> Column:
    """All k-mers in order; those with an N are left out. Strings shorter than k have none, and k must be positive."""
    s, k = _col(s), F.lit(k) if isinstance(k, int) else k
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - k) / _STRIDE).cast("int")), lambda b: F.substring(s, b * _STRIDE + 1, k + _STRIDE - 1))
    every = F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, k))))
    every = F.when((F.length(s) >= k) & (k > 0), every).otherwise(F.array().cast("array<string>"))
    return F.filter(every, lambda x: ~F.contains(x, F.lit("N"))) if skip_n else every


def windows(text: str, k: int) -> np.ndarray:
    """A number for each k-mer of a text of at least k letters, equal ones for equal k-mers.

    Windows double by joining two numbers in one, which are ranked before where both don't fit; memory goes by the text.
    """
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    x = (np.cumsum(np.bincount(x) > 0) - 1)[x]
    w, many = 1, int(x.max()) + 1
    while w < k:
        if many * many >= 1 << 63:
            x = np.unique(x, return_inverse=True)[1]
            many = int(x.max()) + 1
        more = min(w, k - w)
        x, w, many = x[:-more] * many + x[more:], w + more, many * many
    return x


def shared_windows(a: str, b: str, k: int) -> int:
    """How many k-mer occurrences of a are also in b."""
    if k < 1 or min(len(a), len(b)) < k:
        return 0
    both = windows(a + b, k)
    return int(np.isin(both[: len(a) - k + 1], both[len(a) :]).sum())


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")


def counted_kmers(text: str, k: int, least: int = 1) -> list[tuple[str, int]]:
    """The k-mers of a text and its reverse complement that occur `least` times or more in both, with their counts."""
    if k < 1 or len(text) < k:
        return []
    both = text + text[::-1].translate(_COMPLEMENT)
    x, m = windows(both, k), len(text) - k + 1
    x = np.concatenate([x[:m], x[len(text) :]])  # without those that reach over the seam
    _, first, n = np.unique(x, return_index=True, return_counts=True)
    often = n >= least
    at = np.where(first < m, first, first - m + len(text))
    return [(both[i : i + k], c) for i, c in zip(at[often].tolist(), n[often].tolist())]


def repeated(text: str, k: int, skip_n: bool = True) -> bool:
    """Whether some k-mer (without N, if those are skipped) occurs twice: by 64-bit hashes, a repeat being compared."""
    if k < 1 or len(text) <= k:
        return False
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    x, w = letters.astype(np.uint64), 1
    while w < k:
        more = min(w, k - w)
        x, w = x[:-more] * np.uint64(0x9E3779B97F4A7C15) + x[more:], w + more
        x ^= x >> np.uint64(29)
    at = np.arange(len(x))
    if skip_n and "N" in text:
        n = np.concatenate([[0], np.cumsum(letters == ord("N"))])
        at = np.flatnonzero(n[k:] == n[:-k])
    ordered = np.sort(x[at])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return False
    i, j = at[x[at] == twice[0]][:2]
    if text[i : i + k] == text[j : j + k]:
        return True
    exact = np.sort(windows(text, k)[at])
    return bool((exact[1:] == exact[:-1]).any())


def max_repeat_k(s: Column | str, k_min: int = 20, k_max: int = 180, step: int = 20, skip_n: bool = True) -> Column:
    """The largest k of the grid at which some k-mer occurs twice; 0 if none does at k_min.

    A repeat at k implies one at every smaller k, so the grid is climbed until a k has none.
    """
    grid = [k for k in range(k_min, k_max + 1, step) if k > 0]

    @F.pandas_udf("int")
    def largest(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            best = 0
            for k in grid if text is not None else ():
                if not repeated(text, k, skip_n):
                    break
                best = k
            found.append(best)
        return pd.Series(found, dtype="int32")

    return largest(_col(s))


def shared_kmers(a: Column | str, b: Column | str, k: int = 10) -> Column:
    """How many k-mer occurrences of a are also in b: for short strings (`reads.shared_kmer_counts` takes long ones)."""
    once = F.array(F.array_distinct(kmers(b, k, False)))  # bound in a lambda, so that it isn't computed for each k-mer
    return F.get(F.transform(once, lambda other: F.size(F.filter(kmers(a, k, False), lambda x: F.array_contains(other, x)))), F.lit(0))


def base_count(s: Column | str, base: str) -> Column:
    s = _col(s)
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def strand_bias(s: Column | str, many: int = 75, few: int = 20) -> Column:
    """Much G and little C, or the reverse."""
    g, c = base_count(s, "G"), base_count(s, "C")
    return ((g >= many) & (c < few)) | ((c >= many) & (g < few))


def low_complexity(s: Column | str, share: float = 0.8) -> Column:
    """One base makes up more than `share` of the length, plus one."""
    return F.greatest(*(base_count(s, b) for b in "ACGT")) > share * F.length(_col(s)) + 1


def poly_at_rejects(near_clip: Column | str, aligned_length: Column | str, window: int = 20, most: int = 18) -> Column:
    """Whether a clip is rejected: nearly all A or T in the 20 bases beside it, or too few aligned bases."""
    side = F.substring(_col(near_clip), 1, window)
    return (base_count(side, "A") > most) | (base_count(side, "T") > most) | (_col(aligned_length) < window)


def mean_of(quality: Column) -> Column:
    return F.when(F.size(quality) > 0, F.aggregate(quality, F.lit(0.0), lambda a, x: a + x) / F.size(quality))


def clip_is_poor(clip_quality: Column | str, aligned_quality: Column | str, share: float = 0.6) -> Column:
    """Mean quality of the clip below `share` of that of the aligned part."""
    return mean_of(_col(clip_quality)) < share * mean_of(_col(aligned_quality))


def parse_region(text: Column | str) -> Column:
    """`chrom:st-ed` or `chrom_st_ed` as a struct; null if it is neither."""
    t = _col(text)
    pattern = r"^(.+)[:_](\d+)[-_](\d+)$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(t.rlike(pattern), F.struct(part(1).alias("chrom"), part(2).try_cast("int").alias("st"), part(3).try_cast("int").alias("ed")))


def format_region(chrom: Column | str, st: Column | str, ed: Column | str, separators: str = ":-") -> Column:
    return F.concat(_col(chrom), F.lit(separators[0]), _col(st).cast("string"), F.lit(separators[1]), _col(ed).cast("string"))


def phred_add(a: Column | str, b: Column | str) -> Column:
    """log10-Phred sum of two likelihoods, rounded: the larger plus a correction that vanishes from a gap of 20 on."""
    a, b = _col(a), _col(b)
    gap = F.abs(a - b)
    return F.greatest(a, b) + F.when(gap >= 20, F.lit(0)).otherwise(F.round(10 * F.log10(1 + F.pow(F.lit(10.0), -gap / 10)))).cast("int")


def round_insert_size(size: Column | str) -> Column:
    """Keeps three to four leading digits: divided by 10 until at most 1000, and multiplied back."""
    x = _col(size).cast("long")
    out = x
    for k in range(1, 8):
        out = F.when(x > 1000 * 10 ** (k - 1) + (10 ** (k - 1) - 1), F.floor(x / 10**k) * 10**k).otherwise(out)
    return out.cast("long")


MOBILE = ["SINE", "LINE", "Retroposon", "DNA", "RC", "LTR"]
SIMPLE = ["Simple_repeat", "Satellite"]


def is_mobile(kind: Column | str) -> Column:
    """Whether a repeat class is a mobile element."""
    return _col(kind).rlike("|".join(MOBILE))


def is_simple(kind: Column | str) -> Column:
    return _col(kind).rlike("|".join(SIMPLE))


def mobile_type(kind: Column | str) -> Column:
    """The first keyword, in the fixed order, that the class contains; null if none."""
    kind = _col(kind)
    return F.coalesce(*(F.when(F.contains(kind, F.lit(k)), F.lit(k)) for k in MOBILE))


def block_ids(pos: Column | str, step: int, length: int) -> Column:
    """First and last of the overlapping blocks (of `length`, every `step`) that hold a position."""
    pos = _col(pos)
    div = lambda x: F.floor(x / step).cast("long")
    return F.struct(F.greatest(F.lit(0), div(pos - length + step)).cast("long").alias("first"), div(pos).alias("last"))


def error_mask(rows: DataFrame, least: float = 0.5, reach: int = 25) -> DataFrame:
    """Adds `mask` to the k-mers (read, i, kmer, prob) of reads: `P` for poly-A or poly-T k-mers and unlikely ones, `E` for
    those within `reach` of one, else `N`."""
    bad = _col("kmer").rlike("^(A+|T+)$") | (F.coalesce(_col("prob"), F.lit(0.0)) < least)
    near = Window.partitionBy("read").orderBy("i").rangeBetween(-reach, reach)
    return rows.withColumn("_b", bad.cast("int")).withColumn("mask", F.when(F.col("_b") == 1, "P").when(F.max("_b").over(near) == 1, "E").otherwise("N")).drop("_b")
