"""Conversation prefix trie: one ROLLUP over positional turn columns aggregates all prefixes of all conversations.

A turn is known by two 64-bit hashes of role and text and its length. Turns stand in blocks of WIDTH columns, a row for each
conversation and block. A block is keyed by its prior block's node; a node's key is the xor of hashes of (position, turn) of
all turns up to it, two of 64 bits, so that the key of every block comes from a running xor over a conversation's blocks and
all blocks roll up in one job, however long a conversation is. `grouping_id` tells a row's depth in its block.

A node's owner is its smallest member. The nodes that a conversation owns end its path: who is smallest at one depth is so at
all greater ones. So sums over subtrees need no walk: a second ROLLUP adds up what each member owns in all, and from the
owner's part goes what it owns above the node. Digests of members that end in a node are made of chunks of ids, in order,
node by node in a sorted stream, as SHA-256 can't be combined; a task holds a batch of chunks.

No group is held whole: positions come from ranges of (conversation, turn) that are sorted and numbered by themselves and
offsets of the few conversations that span several; other groups are sums, minima and counts that combine before a shuffle.
Windows over a conversation run over one row a block, or over the nodes it owns, and carry a number only.

Defined results: null role and text are empty; turns of equal number follow each other by their hashes; null turns come
first; rows without conversation id belong to none and give no node; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import parts, pick, spread_join, stored

#: Turn columns of a block; ids in a chunk of a digest; the conversations that share a head, and the longest shared head.
WIDTH, CHUNK, FAMILY, HEADS = 8, 1024, 100, 6


def turns(conversations: DataFrame) -> DataFrame:
    """`(conv, pos, turn)` of every row with an id: pos from 1, turn a struct of two hashes and the text's code points."""
    src = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.struct(F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.char_length(text).alias("n"))
    rows = src.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), hashed.alias("turn"))
    rows = stored(rows.repartitionByRange(parts(conversations), "conv", "at", "turn").withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("conv")  # at most one for each partition
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    offsets = stored(counts.join(F.broadcast(stored(spans, "spans")), "conv", "left_semi").select("conv", "part", before.alias("before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at", "turn"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(offsets), ["conv", "part"], "left")
    return placed.select("conv", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "turn")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations, and a row without turn for each: the first h turns of the family's first conversation
    (conv - conv % FAMILY), then the own ones after the first h, with h = crc32(conv) % HEADS."""
    sizes = stored(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("size")), "sizes").withColumn("h", F.crc32(F.col("conv").cast("string")) % HEADS)
    base = F.col("conv") - F.col("conv") % FAMILY
    firsts = sizes.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("size").alias("has"))
    convs = sizes.withColumn("base", base).join(firsts, "base", "left")
    heads = rows.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv").alias("base"), "pos", "turn")  # fewer than HEADS rows of each
    shared = convs.select("conv", "h", "base").join(heads, "base").filter("pos <= h").select("conv", "pos", "turn")
    skip = convs.select("conv", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("m"))
    own = rows.join(skip, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn")
    none = sizes.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"))
    return shared.unionByName(own).unionByName(none)


def _mark(pos: Column, turn: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), pos, turn)


def blocks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each conversation and block: t1 to t<width>, the prior block's node (x, y) and the block's last node."""
    block = F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / width)).otherwise(0).cast("int").alias("block")
    column = (F.pmod(F.col("pos") - 1, F.lit(width)) + 1).alias("col")
    marks = [F.when(F.col("pos") > 0, _mark(F.col("pos"), F.col("turn"), s)).otherwise(0).alias(n) for s, n in enumerate("xy")]
    cells = rows.select("conv", block, column, F.when(F.col("pos") > 0, F.col("turn")).alias("turn"), *marks)
    made = cells.groupBy("conv", "block").agg(*[F.max(F.when(F.col("col") == k, F.col("turn"))).alias(f"t{k}") for k in range(1, width + 1)], F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    upto = Window.partitionBy("conv").orderBy("block")
    last = [F.bit_xor(c).over(upto).alias(n) for c, n in (("bx", "end_x"), ("by", "end_y"))]
    out = made.select("conv", "block", *[f"t{k}" for k in range(1, width + 1)], "bx", "by", *last)
    return out.select("*", F.col("end_x").bitwiseXOR(F.col("bx")).alias("x"), F.col("end_y").bitwiseXOR(F.col("by")).alias("y")).drop("bx", "by")


def _rolled(rows: DataFrame, aggregates: str, width: int = WIDTH) -> DataFrame:
    """One row for each node: its depth, key, parent's key, the text length `n` of its last turn, and the aggregates."""
    columns = [f"t{k}" for k in range(1, width + 1)]
    listed = ", ".join(columns)
    got = rows.sparkSession.sql(f"SELECT block, x, y, {listed}, grouping_id() AS g, {aggregates} FROM {{rows}} GROUP BY block, x, y, ROLLUP({listed})", rows=rows)
    inside = (width - F.bit_count("g")).alias("d")
    turn = F.array(*columns)
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    got = got.withColumn("d", inside).filter((F.col("d") == filled) & ((F.col("d") > 0) | (F.col("block") == 0)))
    first = (F.col("block") * width).cast("long")
    step = lambda seed: [F.when(F.col("d") >= k, _mark(first + k, F.col(f"t{k}"), seed)).otherwise(0) for k in range(1, width + 1)]

    def key(seed: int, name: str, short: int) -> Column:
        out = F.col(name)
        for k, x in enumerate(step(seed), 1):
            out = out.bitwiseXOR(F.when(F.col("d") - short >= k, x).otherwise(0))
        return out

    node = lambda short: F.struct(key(0, "x", short).alias("x"), key(1, "y", short).alias("y"))
    names = [x.split(" AS ")[1] for x in aggregates.split(", ")]
    depth = (first + F.col("d")).alias("depth")
    return got.select(depth, node(0).alias("node"), F.when(depth > 0, node(1)).alias("parent"), F.coalesce(F.get(turn, F.col("d") - 1)["n"], F.lit(0)).cast("long").alias("n"), *names)


def end_digests(ends: DataFrame) -> DataFrame:
    """`(node, ends_sha256)` of `(node, conv)`: SHA-256 of each node's conversations, ascending, joined by commas."""
    chunks = ends.groupBy("node", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))  # ids differ: CHUNK at most
    ordered = chunks.select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), "chunk", "ids")
    ordered = ordered.repartition(parts(ends), "x", "y").sortWithinPartitions("x", "y", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for b in batches:
            out: list[tuple] = []
            for x, y, ids in zip(*(b.column(c).to_pylist() for c in ("x", "y", "ids"))):
                if held == (x, y):
                    digest.update(b"," + ids.encode())
                    continue
                if held:
                    out.append((*held, digest.hexdigest()))
                held, digest = (x, y), hashlib.sha256(ids.encode())
            yield _digests(out)
        if held:
            yield _digests([(*held, digest.hexdigest())])

    return ordered.mapInArrow(run, "x bigint, y bigint, ends_sha256 string").select(F.struct("x", "y").alias("node"), "ends_sha256")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])


def nodes(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. saved_tokens: over the subtree, code points of each node's last text times its members but one."""
    rows = stored(blocks(rebuilt(stored(turns(conversations), "positions")), width), "blocks")
    every = stored(_rolled(rows, "count(1) AS n_convs, min(conv) AS conv", width), "nodes")

    children = every.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    every = every.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", (F.col("n_convs") - 1) * F.col("n"))
    upto = F.sum("saved").over(Window.partitionBy("conv").orderBy("depth"))
    every = stored(every.withColumn("above", upto - F.col("saved")), "owned")  # saved by nodes of the same owner above this one
    owns = every.groupBy("conv").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = _rolled(rows.join(owns, "conv", "left"), "sum(saved) AS saved, sum(leaves) AS n_leaves", width).select("node", F.col("saved").alias("members_saved"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))

    last = rows.groupBy("conv").agg(F.max_by(F.struct(F.col("end_x").alias("x"), F.col("end_y").alias("y")), "block").alias("node"))
    digests = end_digests(last.select("node", "conv"))
    full = stored(every.join(sums, "node").join(digests, "node", "left"), "full")
    above = full.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    inner = spread_join(full.filter("parent is not null"), above, "parent", F.col("node"))
    out = inner.unionByName(full.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.coalesce("members_saved", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
