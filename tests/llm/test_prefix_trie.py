"""The prefix trie against plain prefixes, over borders of tasks and of blocks, and on odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lexmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, borrowed=4):
    """Every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % borrowed
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].add(c)
        ends[whole].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in nodes:
        if node:
            kids[node[:-1]] += 1
    for node, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members) - 1) * words
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def sample(seed, n=400, longest=9, alphabet=2):
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        c = rnd.randrange(1000)
        turns = [(rnd.choice(["user", "assistant", None]) if rnd.random() < 0.1 else "user", f"{'w ' * rnd.randrange(alphabet)}x") for _ in range(rnd.randint(1, longest))]
        rows += [(c, i if rnd.random() > 0.05 else None, role, text) for i, (role, text) in enumerate(turns)]
    return rows


def trie(frame, **options):
    return sorted(map(tuple, prefix_trie.conversation_trie(frame, **options).collect()))


@pytest.mark.parametrize("parts,merged,block", [(1, 64, 256), (23, 64, 256), (17, 3, 256), (5, 64, 3), (13, 2, 2)])
def test_tries_equal_plain_prefixes(spark, monkeypatch, parts, merged, block):
    """However conversations fall into tasks, forests into groups and turns into blocks."""
    monkeypatch.setattr(prefix_trie, "MERGED", merged)
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sample(parts)
        assert trie(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def test_long_conversations_and_copies(spark):
    """Two long conversations that part late, copies of one, one that is alone, and one that ends where blocks do."""
    rnd = random.Random(2)
    long = [f"t{rnd.randrange(9)} y" for _ in range(61)]
    rows = [(20 * c, i, "user", t) for c in (1, 2, 3, 7) for i, t in enumerate(long)]
    rows += [(80, i, "user", t) for i, t in enumerate([*long[:47], "other", *long[48:]])]
    rows += [(100, i, "user", t) for i, t in enumerate(long[:16])] + [(120, i, "bot", f"alone {i}") for i in range(50)]
    rows += [(5, 0, "user", "gone"), (26, None, None, None), (45, 0, None, "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows)
    for block in (8, 16, 64):
        assert trie(frame, block=block) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "of nobody"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 5, "a", "word " * 50_000), (4, 0, "xé", "\U0001f600"), (40, 0, "user", "one")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "words", "part", "local", "pos", "d", "n", "kids", "base", "h"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    assert trie(frame) == plain(rows)
    assert trie(frame.limit(0)) == []


def test_all_alike_have_one_chain(spark):
    rows = [(c, i, "user", f"turn {i}") for c in range(0, 3000, 20) for i in range(4)]
    got = trie(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and len(got) == 5


def test_pieces_of_ids_hash_as_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 30)
    rows = [(c, 0, "user", "hello") for c in range(0, 4000, 20)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
