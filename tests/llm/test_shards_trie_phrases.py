"""Sharding, the prefix trie and collocations against plain versions, on odd tables and on the driver's small ones."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import phrases, shards, trie
from strandloom.llm import queries as q

FOLDER = "/root/testdata/sf0.001"


def saved(df, spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/t-{random.random()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------------------------------------------- shards


def plain_walk(amount, owner, room):
    """Arc by arc and step by step."""
    left, room, out, step = list(amount), list(room), [], 0
    while any(left):
        for a in range(len(left)):
            s = owner[(a + step) % len(owner)]
            got = min(left[a], room[s])
            if got:
                out.append((a, amount[a] - left[a], s))
                left[a] -= got
                room[s] -= got
        step += 1
    return sorted(out)


def test_walk_equals_a_plain_loop():
    for seed in range(200):
        r = random.Random(seed)
        n, k = r.randrange(1, 60), r.randrange(1, 6)
        owner = [r.randrange(k) for _ in range(n)] + list(range(k))
        amount = [r.choice([0, r.randrange(50), r.randrange(5000)]) for _ in owner]
        room = -(-sum(amount) // k) + r.randrange(3)
        got = shards.walk(np.array(amount), np.array(owner, np.int32), np.full(k, room))
        assert list(zip(*(x.tolist() for x in got))) == plain_walk(amount, owner, [room] * k)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(400) + str(i)) for i in range(6000)]
    rows += [(10_000 + i, "the same text " * 12) for i in range(3000)] + [(20_000 + k, f"copy {k // 3} " * 20) for k in range(600)]
    rows += [(None, None), (None, ""), (7, ""), (7, ""), (8, None), (9, "é" * 500), (9, "漢字")]
    return saved(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("other", F.lit(1)).repartition(5), spark)


def test_shards_are_near_equal_and_keep_groups(spark, texts):
    got = shards.assign(texts, 10, 256).collect()
    assert len(got) == texts.count()
    load, slots, by_text = Counter(), defaultdict(list), defaultdict(Counter)
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
        by_text[x.h][x.shard] += 1
    mean = sum(load.values()) / 10
    piece = mean / shards.PIECE + 600
    assert max(load.values()) <= mean * 1.002 + 2 * piece and min(load.values()) >= mean * (1 - 9 * 0.002) - 2 * piece
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    split = [h for h, c in by_text.items() if len(c) > 1]
    assert len(split) <= 3  # the large group, and few that an edge cuts
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in texts.collect())
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == want
    again = shards.assign(texts.repartition(9), 10, 256).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_one_more_shard_moves_little(spark, texts):
    docs = texts.filter("doc_id < 7000").dropDuplicates(["doc_id"])
    a, b = ({x.doc_id: (x.shard, x.home) for x in shards.assign(docs, n, 256).collect()} for n in (10, 11))
    assert all(b[i][1] in (a[i][1], 10) for i in a)  # the ring itself gives rows to the new shard alone
    other = sum(a[i][0] != b[i][0] and b[i][0] != 10 for i in a)
    assert other < 0.15 * len(a), other / len(a)


def test_shards_of_odd_tables_and_files(spark, texts, tmp_path):
    none = texts.limit(0)
    assert shards.assign(none, 4).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(x.slot, x.size) for x in shards.assign(one, 40).collect()] == [(0, 17)]
    docs = texts.toDF("doc_id", "text", "shard", "TEXT")
    shards.write(docs, f"{tmp_path}/out", 5, 64)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {"doc_id", "text", "shard"} and back.count() == docs.count()
    rows = shards.assign(docs.toDF("doc_id", "text", "a", "b"), 5, 64)
    assert sorted(map(str, rows.select("doc_id", "shard").collect())) == sorted(map(str, back.select("doc_id", "shard").collect()))


# ------------------------------------------------------------------------------------------------------------------ trie


def plain_nodes(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    for v in convs.values():
        v.sort()
    path = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = [x[2:] for x in convs.get(c - c % 100, [])[:h] + own[h:]]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in path.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved_tokens = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved_tokens[p] = sum(saved_tokens[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(path[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved_tokens[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs=400):
    """Shared starts, long conversations, missing first conversations of families, nulls, and turns whose parts could blur."""
    r = random.Random(seed)
    starts = [[(r.choice(["user", "", None]), f"start {k} {d}") for d in range(30)] for k in range(4)]
    rows = []
    for c in r.sample(range(0, 1000), convs):
        n = r.choice([1, 2, 3, 5, 8, 9, 16, 17, r.randrange(1, 60)])
        shared = starts[r.randrange(4)][: r.randrange(0, n + 1)]
        turns = shared + [(r.choice(["a", "ab", None]), r.choice(["", "b", "bb", None, f"own {r.randrange(3)}"])) for _ in range(n - len(shared))]
        rows += [(c, None if d == 0 and r.random() < 0.3 else d, *x) for d, x in enumerate(turns)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 4, 8])
def test_trie_equals_a_plain_one(spark, width):
    rows = talk(width)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, node string")
    got = sorted(map(tuple, trie.nodes(saved(df, spark), width).collect()), key=str)
    assert got == plain_nodes(rows)


def test_trie_of_one_conversation_over_many_ranges_and_of_copies(spark):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(5000)] + [(c, t, "user", f"turn {t}") for c in range(200, 2600) for t in range(3)]
    df = saved(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6), spark)
    assert sorted(map(tuple, trie.nodes(df).collect()), key=str) == plain_nodes(rows)
    assert trie.nodes(df.limit(0)).count() == 0
    alone = trie.nodes(df.filter("conv_id = 201")).collect()
    assert sorted(map(tuple, alone), key=str) == plain_nodes([x for x in rows if x[0] == 201])


def test_trie_of_repeated_turns(spark):
    rows = [(1, 1, "u", "same"), (1, 1, "u", "same"), (1, 2, "u", "x"), (3, 1, "u", "same"), (3, 1, "u", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.nodes(df).collect()), key=str) == plain_nodes(rows)


# --------------------------------------------------------------------------------------------------------------- phrases


def plain_collocations(rows, least, most=2000, longest=4):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    if 100 * a >= 80 * c[p[s : s + k]]:
                        gone.add(p[s : s + k])
        listed = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:most], 1)]
    return sorted(out)


def chatter(seed, docs=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "É,", "the x", "a\tb", "x.y!z", "naïve", "\x00", "漢字", "THE", "the;", "z\r\nq", "\x0b"]
    rows = [(" ".join(r.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=r.randrange(0, 60))), r.choice(["en", "de", None, "und"])) for _ in range(docs)]
    return rows + [(None, "en"), ("", None), ("  \t ", "fr"), ("of the " * 4000, "en"), ("one", "de")] + [("this passage comes again and again here", "en")] * 40


@pytest.mark.parametrize("least", [3, 30])
def test_collocations_equal_plain_counts(spark, least, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 700)
    rows = chatter(least)
    df = saved(spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, w1 int").repartition(4), spark)
    want = plain_collocations(rows, least)
    assert sorted(map(tuple, phrases.collocations(df, least).collect())) == want and len(want) > 10
    few = phrases.collocations(df, least, most=5).collect()
    assert sorted(map(tuple, few)) == plain_collocations(rows, least, 5)
    assert phrases.collocations(df.limit(0), least).count() == 0


def test_full_filter_changes_no_count(spark, monkeypatch):
    rows = chatter(9)
    df = saved(spark.createDataFrame(rows, "text string, lang string"), spark)
    monkeypatch.setattr(phrases, "known_phrases", lambda found, m: np.full(1 << 10, 255, np.uint8))
    assert sorted(map(tuple, phrases.collocations(df, 5).collect())) == plain_collocations(rows, 5)


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, [big + 3, big], [big + 7, big])], "c long, heads array<long>, tails array<long>")
    got = row.select(phrases.best_cut(2).alias("x")).first().x
    assert (got.score, got.l, got.r) == (2_000_000 * big // (2 * big + 10), big + 3, big + 7)


# ------------------------------------------------------------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_collocations"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = c.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_sharding_query_has_the_columns_asked_for(spark):
    got = q.op11_sharding(spark, FOLDER)
    assert [f"{n} {t}" for n, t in got.dtypes][:7] == ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"]
    assert got.filter("law <> 'bytes' or shard not between 0 and 39").count() == 0
