"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: White space that separates words: blank and the control characters 0x09 to 0x0D. `bytes.split()` splits on just these.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone, found by exact name (the first of equal names), so that other columns can't clash."""
    wanted = [*((n, n) for n in names), *((new, old) for new, old in renamed.items())]
    at = [df.columns.index(old) for _, old in wanted]
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{i}").alias(new) for i, (new, _) in zip(at, wanted)])


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as _c0, _c1 and so on, so that no name, even one that occurs twice, clashes with a helper's."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets a new one; on a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes folders, by way of the file system that they are on."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Inside, the tables that `stored` writes are listed; at the end they are deleted, except the last.

    For steps whose result was stored last: a lazy result still needs its tables.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
    delete(spark, *made[:-1])
    if (outer := _MADE.get()) is not None:
        outer += made[-1:]


#: Bytes of input (files as they are) for each shuffle partition, and the most partitions.
PART_BYTES, MOST_PARTS = 64 << 20, 50_000


def parts(df: DataFrame, times: int = 1) -> int:
    """Partitions for a shuffle of `df`, times `times`: as many as the session asks for, or more where the files that it is
    read from are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # more stands for unknown
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS)) * times


#: A key with more than one row in so many, and more than so many rows, is spread over several tasks.
SHARE, FEW = 4096, 5000


def heavy(df: DataFrame, key: str) -> DataFrame:
    """`(key, _pieces)` of the keys that hold more than 1 / SHARE of all rows: at most SHARE of them, so they may be
    broadcast. _pieces: into how many pieces to cut each."""
    least = max(df.count() // SHARE, FEW)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_pieces"))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """`left.join(right, key, how)` (inner, left or left_semi) where single keys may hold a large share of left's rows.

    Heavy keys are cut into pieces by a hash of `by`; right's rows of such a key go to each piece. hot: left's heavy keys;
    otherwise `left` is read twice and should be a stored table.
    """
    hot = F.broadcast(stored(heavy(left, key) if hot is None else hot, "heavy"))
    a = left.join(hot, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    b = right.join(hot, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return a.join(b, [key, "_piece"], how).drop("_piece")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of at most so many rows and so many bytes of strings (or one row), to bound what a step holds."""
    for batch in batches:
        width = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                width += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(width), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            to = min(batch.num_rows, at + rows, max(at + 1, full))
            yield batch.slice(at, to - at)
            at = to


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length as one compressed value: byte by byte of all rows, so that equal bytes meet."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    """The columns that `packed` took, of the given types."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def packed_apart(*columns: np.ndarray) -> bytes:
    """As `packed`, but each byte of the integers is compressed by itself where that helps: random bytes don't spoil what the
    others spare, which pays for small batches."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = []
    for c in columns:
        for plane in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T:
            raw = plane.tobytes() if plane.any() else b""
            small = squeeze(raw) if raw else b""
            out += [len(small).to_bytes(4, "little"), small] if len(small) < len(raw) or not raw else [b"\xff" * 4, raw]
    return len(columns[0]).to_bytes(4, "little") + b"".join(out)


def unpacked_apart(data: bytes, *kinds) -> list[np.ndarray]:
    """The columns that `packed_apart` took, of the given types."""
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    spread = zstandard.ZstdDecompressor().decompress
    for k in kinds:
        planes = np.zeros((np.dtype(k).itemsize, n), np.uint8)
        for plane in planes:
            size, at = int.from_bytes(data[at : at + 4], "little"), at + 4
            if size == 2**32 - 1:
                plane[:], at = np.frombuffer(data, np.uint8, n, at), at + n
            elif size:
                plane[:], at = np.frombuffer(spread(data[at : at + size]), np.uint8), at + size
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
    return out


#: Bits of a filter as powers of two: at least, at most (128 MB), and of the slices that travel to the driver one by one.
LEAST_BITS, MOST_BITS, SLICE_BITS = 23, 30, 23


def filter_bits(n: int) -> int:
    """Bits, as a power of two, of a filter of n entries: 16 to 32 for each, so that it takes one in 16 others at most, as far
    as MOST_BITS go: from 67 million entries on more, at a billion two in three."""
    return min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)


def bit_filter(places: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, in bytes, of which those at the numbers in the one column of `places` are set.

    Numbers combine to words of 64 bits before the shuffle; at most 128 slices of 1 MB travel to the driver.
    """

    def gathered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (SLICE_BITS - 6), np.int64)
        for b in batches:
            out[b.column("word").to_numpy() & (len(out) - 1)] = b.column("v").to_numpy()
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    at = places.toDF("at")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    rows = words.groupBy(F.shiftright("word", SLICE_BITS - 6).alias("slice")).applyInArrow(gathered, "slice bigint, data binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r.slice << (SLICE_BITS - 3) : (r.slice + 1) << (SLICE_BITS - 3)] = np.frombuffer(r.data, np.uint8)
    return out


def split_by_ids(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` in two: rows whose id may be in the one-column `ids`, and rows whose id certainly isn't.

    One bit per id in a filter whose size goes by their number (`filter_bits`): one in 16 other rows at most counts as
    possible, more when it is at its largest, and results that come from a join afterwards stay the same. It spares most texts
    a shuffle. `ids` is read twice and should be a stored table.
    """
    bits = filter_bits(ids.count())
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    sent = df.sparkSession.sparkContext.broadcast(bit_filter(ids.select(place(ids.columns[0])), bits))

    @F.pandas_udf(BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        b = h.to_numpy(np.int64)
        return pd.Series((sent.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    at = maybe(place(F.col(id_col)))
    return df.filter(at), df.filter(~at)


def classes_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """The class of each hash; classes is a power of two."""
    return (hashes & np.uint64(classes - 1)).astype(np.int64)


def class_frequency(texts: DataFrame, hashes: Callable[[bytes], np.ndarray], classes: int, chunks: int = 64) -> tuple[np.ndarray, int]:
    """For each class of hashes the number of texts (of the one column) that have one in it, and the number of texts.

    Each task sums its own and ships compressed chunks, which are added up by chunk: what tasks and driver hold depends
    on `classes` alone.
    """
    width = classes // chunks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(classes, np.int32), 0
        for b in pieces(batches, 500):
            for raw in as_bytes(b.column(0)):
                df[np.unique(classes_of(hashes(raw), classes))] += 1
            n += b.num_rows
        if n:
            blobs = [zlib.compress(df[k * width : (k + 1) * width].tobytes(), 1) for k in range(chunks)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(chunks), pa.int32()), "n": pa.array([n] * chunks, pa.int64()), "df": pa.array(blobs, pa.binary()), "kind": pa.array(["int32"] * chunks)})

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(width, np.int64), 0
        for b in batches:
            for x, m, kind in zip(b.column("df").to_pylist(), b.column("n").to_pylist(), b.column("kind").to_pylist()):
                df += np.frombuffer(zlib.decompress(x), kind)
                n += m
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "df": pa.array([zlib.compress(df.tobytes(), 1)], pa.binary()), "kind": pa.array(["int64"])})

    schema = "chunk int, n bigint, df binary, kind string"
    rows = texts.mapInArrow(count, schema).groupBy("chunk").applyInArrow(added, schema).collect()  # `chunks` rows at most
    df, n = np.zeros(classes, np.int64), 0
    for r in rows:
        df[r.chunk * width : (r.chunk + 1) * width], n = np.frombuffer(zlib.decompress(r.df), np.int64), r.n
    return df, n


def components(links: DataFrame) -> DataFrame:
    """`(node, component)` of every node in `links` (columns a, b): component is the smallest node that links lead to.

    Rounds of large-star and small-star: each node points its neighbours to the smallest of them, larger and smaller ones
    in turn, until nothing changes. Minima combine before the shuffle, so a node with many links does no harm.
    """
    with scratch(links.sparkSession):
        edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            edges = stored(small, "edges")
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
