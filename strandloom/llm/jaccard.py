"""N-gram Jaccard join by grouped prefixes.

Two texts link when their sets of word shingles have a Jaccard similarity of at least `percent`/100. Shingles are ordered
from rare to common (by document frequency in hashed classes, counted over all texts); linked texts then share a shingle
in their prefixes. Texts with equal sets become one class, and classes with identical prefix and size one group.

1. Prefixes go to ranges of shingles, packed; each range lists the groups of a shingle. Shingles of one group drop out.
2. Every group on a list is paired with the list's leader (where the shingle comes first in the prefix: in a family of
   near copies the one with the fewest words of its own), if sizes and places allow the similarity, and every class of a
   group with the group's first class. The first classes of paired groups, and these, are filtered by a bitmap bound on
   the overlap and verified on whole sets. So families of any size are joined by pairs linear in their size.
3. Classes on a list, or in a group, that are still in different components are compared by size, place and bitmap, and
   those that pass are verified likewise. Classes of one component could add nothing to it, so no link between components
   is lost. A list of more than SLICE classes is cut into slices, and each pair of slices is a task's work of its own.

Sets are compared by 64-bit shingle hashes. Texts travel only for groups that have a candidate.

Defined results: A-Z are lower-cased; a text of fewer words than a shingle is one shingle; null or wordless text has
size 0 and links with nothing; `component_id` is the smallest id in the component, null where all its ids are null;
repeated rows are equal sets; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_bytes, class_frequency, classes_of, components, heavy, numbered, packed, parts, pick, pieces, scratch, split_by_ids, spread_join, stored, unpacked
from strandloom.llm.windows import _grouped, window_hashes, word_hashes

CLASSES, CHUNK, SLICE = 1 << 22, 500_000, 2000


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.lower().split()
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(width, len(words)))) if words else h


def _bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle in four to eight times as many bits, a power of two."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    flag = np.zeros(bits, bool)
    flag[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(flag, bitorder="little").tobytes()


def _differ(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two bitmaps (of 64-bit words) differ, the larger folded to the smaller: no more than sets differ."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _apart(words: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """`_differ` of one bitmap to several, those of its own size at once."""
    own = words[i]
    out = np.empty(len(others), np.int64)
    same = np.array([len(words[k]) == len(own) for k in others.tolist()])
    if same.any():
        out[same] = np.bitwise_count(np.stack(words[others[same]].tolist()) ^ own).sum(axis=1, dtype=np.int64)
    for k in np.flatnonzero(~same).tolist():
        out[k] = _differ(own, words[others[k]])
    return out


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`(key, doc_id, n, cls, grp, prefix, bits)` of every row: cls tells sets apart, grp prefix and size."""
    df, _ = class_frequency(docs.select("text"), lambda raw: shingles(raw, width), CLASSES)
    sent = docs.sparkSession.sparkContext.broadcast(df.astype(np.int32) if df.max(initial=0) < 2**31 else df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in pieces(batches, 500):
            n, cls, grp, prefix, bits = [], [], [], [], []
            for raw in as_bytes(b.column(2)):
                s = shingles(raw, width)
                p = s[np.lexsort((s, often[classes_of(s, CLASSES)]))[: _prefix_size(len(s), percent)]] if len(s) else s
                n.append(len(s))
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                grp.append(xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(s)))
                prefix.append(p.tobytes())
                bits.append(_bitmap(s) if len(s) else None)
            hashed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, grp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *hashed, pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], names=["key", "doc_id", "n", "cls", "grp", "prefix", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("key", "doc_id", "text").mapInArrow(run, f"key bigint, doc_id {kind}, n bigint, cls bigint, grp bigint, prefix binary, bits binary"), "described")


def _lists(described: DataFrame) -> DataFrame:
    """`(token, grp, n, at, lead_grp, lead_n, lead_at)`: groups that share a token of their prefixes, with the leader."""
    ranges = parts(described, 4)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, n, prefix, held, seen = [], [], [], 0, set()

        def sent() -> pa.RecordBatch:
            size = [len(p) for p in prefix]
            token = np.concatenate(prefix)
            of = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            by = np.argsort(token, kind="stable")
            token, of, at = token[by], of[by], at[by].astype(np.uint32)
            g, m = np.array(grp, np.int64)[of], np.array(n, np.int64)[of].astype(np.uint32)
            which = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            keys, blobs = [], []
            for k, (t, x, y, z) in _grouped(which, token, g, m, at):
                keys.append(k)
                blobs.append(packed(np.diff(t, prepend=np.uint64(0)), x, y, z))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["k", "data"])

        for b in pieces(batches, 1000):
            for x, m, p in zip(*(c.to_pylist() for c in b.columns)):
                if m and x not in seen:
                    seen.add(x)
                    grp.append(x)
                    n.append(m)
                    prefix.append(np.frombuffer(p, np.uint64))
                    held += len(prefix[-1])
            if held >= CHUNK:
                yield sent()
                grp, n, prefix, held, seen = [], [], [], 0, set()
        if grp:
            yield sent()

    def listed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = (unpacked(v, np.uint64, np.int64, np.uint32, np.uint32) for v in table.column("data").to_pylist())
        token, grp, n, at = map(np.concatenate, zip(*((np.cumsum(t, dtype=np.uint64), g, m, p) for t, g, m, p in read)))
        by = np.lexsort((grp, n, at, token))
        token, grp, n, at = token[by], grp[by], n[by], at[by]
        head = np.append(True, token[1:] != token[:-1])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(token)), 0))
        # a group that came from several chunks counts once: keep its first
        again = np.lexsort((grp, token))
        same = np.append(False, (token[again][1:] == token[again][:-1]) & (grp[again][1:] == grp[again][:-1]))
        once = np.ones(len(token), bool)
        once[again] = ~same
        once |= head
        count = np.bincount(np.cumsum(head) - 1, weights=once)
        keep = once & (count[np.cumsum(head) - 1] > 1)
        lead = lead[keep]
        cols = [token[keep].view(np.int64), grp[keep], n[keep], at[keep], grp[lead], n[lead], at[lead]]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=names)

    names = ["token", "grp", "n", "at", "lead_grp", "lead_n", "lead_at"]
    rows = described.select("grp", "n", "prefix").mapInArrow(postings, "k int, data binary")
    return stored(rows.groupBy("k").applyInArrow(listed, ", ".join(f"{c} bigint" for c in names)), "lists")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs of structs `ma`, `mb` (cls, key, n, bits) the pairs `(a, b, ka, kb)` of classes, with the key of a
    row each, whose sizes and bitmaps leave the similarity open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2000):
            out = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total = x["n"] + y["n"]
                differ = _differ(np.frombuffer(x["bits"], np.uint64), np.frombuffer(y["bits"], np.uint64))
                if (total - differ) * (100 + percent) >= 2 * percent * total:
                    out.append((x["cls"], y["cls"], x["key"], y["key"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "ka", "kb"])

    return stored(pairs.select("ma", "mb").mapInArrow(run, "a bigint, b bigint, ka bigint, kb bigint").distinct(), "pairs")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links `(a, b)` of `pairs` (a, b, ka, kb; stored). Many pairs may share their kb."""
    keys = stored(pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct(), "keys")
    some, _ = split_by_ids(docs.select("key", "text"), "key", keys)
    some = some.dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, y = None, None
        for b in pieces(batches, 500):
            links = []
            for x, z in zip(as_bytes(b.column(2)), as_bytes(b.column(3))):
                x = shingles(x, width)
                if z != raw:  # rows come sorted by kb
                    raw, y = z, shingles(z, width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    hot = heavy(pairs, "kb")
    both = pairs.join(some.select(F.col("key").alias("ka"), F.col("text").alias("ta")), "ka")
    both = spread_join(both, some.select(F.col("key").alias("kb"), F.col("text").alias("tb")), "kb", F.col("a"), hot=hot)
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _possible(na, nb, ia, ib, percent: int):
    """Whether sizes and the places of a shared shingle in the prefixes leave the similarity open."""
    most = F.least(ia, ib) + 1 + F.least(na - ia - 1, nb - ib - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most * (100 + percent) >= percent * (na + nb))


def _across(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs `(a, b, ka, kb)` of classes on one list, or in one group, that are in different components and whose sizes,
    places and bitmaps leave the similarity open. members: `(grp, cls, key, n, bits, component)` of every class."""
    ranges = parts(lists, 4)
    per = members.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    own = per.filter("low <> high").select(F.col("grp").alias("token"), "grp", "n", F.lit(0).cast("long").alias("at"), F.lit(True).alias("own"))
    rows = lists.select("token", "grp", "n", "at", F.lit(False).alias("own")).unionByName(own)
    mixed = rows.join(per.drop("n"), "grp").groupBy("token", "own").agg(F.min("low").alias("x"), F.max("high").alias("y"), F.sum("m").alias("m"))
    mixed = mixed.filter("x <> y and m > 2").select("token", "own", F.ceil(F.col("m") / SLICE).cast("int").alias("slices"))  # two were compared before
    rows = rows.join(mixed, ["token", "own"]).join(members.drop("n"), "grp").withColumn("s", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("block", F.xxhash64("token", "own", F.least("s", "t"), F.greatest("s", "t")))
    rows = rows.select(F.pmod("block", F.lit(ranges)).cast("int").alias("k"), "block", "grp", "cls", "key", "n", "at", "component", F.when(F.col("s") == F.col("t"), -1).otherwise(F.col("s")).alias("s"), "own", "bits")

    def crossed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ["block", "n", "cls", "grp", "key", "at", "component", "s", "own"]
        cols = [table.column(c).to_numpy() for c in names]
        word = np.empty(len(cols[0]), object)
        word[:] = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        by = np.lexsort((cols[2], cols[1], cols[0]))
        out = []
        for _, (m, x, g, r, p, c, s, o, w) in _grouped(cols[0][by], *(v[by] for v in cols[1:]), word[by]):
            far = np.searchsorted(m, m * 100 // percent, side="right")  # sizes ascend: partners end here
            for i in range(len(m) - 1):
                j = np.arange(i + 1, far[i])
                j = j[(c[j] != c[i]) & ((g[j] == g[i]) == o[i]) & ((s[j] < 0) | (s[j] != s[i]))]
                total = m[j] + m[i]
                most = np.minimum(p[j], p[i]) + 1 + np.minimum(m[j] - p[j] - 1, m[i] - p[i] - 1)
                j = j[most * (100 + percent) >= percent * total]
                if len(j):
                    total = m[j] + m[i]
                    j = j[(total - _apart(w, i, j)) * (100 + percent) >= 2 * percent * total]
                    out += [(x[i], y, r[i], k) if x[i] > y else (y, x[i], k, r[i]) for y, k in zip(x[j], r[j])]
        found = np.array(out, np.int64).reshape(-1, 4)
        return pa.table([pa.array(found[:, k]) for k in range(4)], names=["a", "b", "ka", "kb"])

    return rows.groupBy("k").applyInArrow(crossed, "a bigint, b bigint, ka bigint, kb bigint").distinct()


def classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(key, doc_id, n_shingles, component_id, first)` of every row. key: hash of id and text; first: the key of the row that
    stands for the component, one of the smallest id, nulls last."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col}).withColumn("key", F.xxhash64("doc_id", "text"))
    described = _described(src, width, percent)
    with scratch(docs.sparkSession):
        members = described.filter("n > 0").groupBy("grp", "cls").agg(F.min(F.struct("key", "n", "bits")).alias("m"))
        members = stored(members.select("grp", "cls", "m.*"), "members")
        lists = _lists(described)
        one = F.struct("cls", "key", "n", "bits")
        first_of = members.groupBy("grp").agg(F.min(one).alias("m"))
        star = lists.filter("grp <> lead_grp").filter(_possible(F.col("n"), F.col("lead_n"), F.col("at"), F.col("lead_at"), percent))
        star = stored(star.select("grp", "lead_grp").distinct(), "star")
        lead = first_of.select(F.col("grp").alias("lead_grp"), F.col("m").alias("mb"))
        pairs = spread_join(star.join(first_of.select("grp", F.col("m").alias("ma")), "grp"), lead, "lead_grp", F.col("grp"), hot=heavy(star, "lead_grp"))
        within = spread_join(members, first_of.withColumnRenamed("m", "mb"), "grp", F.col("cls")).filter("cls <> mb.cls").withColumn("ma", one)
        pairs = _likely(pairs.select("ma", "mb").unionByName(within.select("ma", "mb")), percent)
        first = _verified(src, pairs, width, percent)
        label = components(first)
        members = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))  # a class without a link is its own
        known = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = stored(_across(lists, stored(members, "members"), percent).join(known, ["a", "b"], "left_anti"), "across")
        second = _verified(src, across, width, percent)
        label = stored(components(first.unionByName(second)), "components")
    nodes = described.select("key", "doc_id", "n", F.col("cls").alias("node")).join(label, "node", "left").withColumn("component", F.coalesce("component", F.when(F.col("n") > 0, F.col("node"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), "key"))["key"]
    least = nodes.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), first.alias("first"))
    out = nodes.join(least, "component", "left").select("key", "doc_id", F.col("n").alias("n_shingles"), "least", "first")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("key", "doc_id", "n_shingles", "component_id", F.coalesce("first", "key").alias("first"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, of the smallest id there (nulls last). Of rows equal in id and text one stays.
    Columns keep their names, whatever they are; of equal names the first counts as id or text."""
    found = classes(docs, width, percent, id_col, text_col)
    gone = found.filter("key <> first").select(F.col("key").alias("_key")).distinct()
    of = [F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col)]
    keyed = numbered(docs).withColumn("_key", F.xxhash64(*of))
    return keyed.join(gone, "_key", "left_anti").dropDuplicates(["_key"]).drop("_key").toDF(*docs.columns)
