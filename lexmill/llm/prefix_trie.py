"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, deepest first."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .mixing import word_count

#: Turns of a block: what one row holds of a conversation, and bytes of a turn's key.
BLOCK, KEY = 256, 16
#: Forests that one task merges, and characters of a piece of joined ids.
MERGED, PIECE = 64, 1 << 16

#: Of tries: nodes, the minima of nodes that were open at the border of a task, forests still open, roots of blocks.
_OUT = "kind string, place int, conv_id long, depth long, parent long, n long, kids long, leaves long, saved long, ends long, pkey binary, tree binary, s1 long, s2 long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = [_TYPES[x.split()[1]] for x in _OUT.split(", ")]


@dataclass
class Path:
    """The turns' keys of one block of a conversation, their words, the turns before it by their signature, and the
    smallest member of the node that those make (null for the first block)."""

    group: tuple[int, int]
    keys: bytes
    words: np.ndarray
    top: int | None = None

    def common(self, other: Path) -> int:
        """How many turns both begin with; -1 if what comes before differs."""
        if self.group != other.group:
            return -1
        n = min(len(self.keys), len(other.keys))
        if self.keys[:n] == other.keys[:n]:
            return n // KEY
        return int((np.frombuffer(self.keys, np.uint8, n) != np.frombuffer(other.keys, np.uint8, n)).argmax()) // KEY


@dataclass
class Part:
    """A node at the depth of its path, or what is known of it: members, children and what lies below."""

    path: Path
    depth: int
    n: int
    least: int
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: int | None = None
    was_open: bool = False
    pending: list[int] = field(default_factory=list)


class Forest:
    """Joins neighbours in descending order of their common prefix and writes the nodes that are complete."""

    def __init__(self, base: int, level: int):
        self.base, self.level = base, level
        self.rows: list[list] = []

    def key(self, part: Part) -> bytes:
        head = f"{self.level}|{part.path.group}|".encode()
        return hashlib.md5(head + part.path.keys[: part.depth * KEY]).digest()

    def _finish(self, part: Part) -> None:
        """The children of a complete node learn its smallest member."""
        for i in part.pending:
            self.rows[i][4] = part.least
        part.pending = []
        if part.was_open:
            self.rows.append(["close", None, None, None, part.least, None, None, None, None, None, self.key(part), None, None, None])

    def _lift(self, part: Part, depth: int, into: Part) -> None:
        """Makes a complete node, and the single children above it, a child of a node at a smaller depth."""
        self._finish(part)
        leaves, saved, kids, ends = part.leaves if part.kids else 1, part.saved, part.kids, part.ends
        for d in range(part.depth, depth, -1):
            saved += (part.n - 1) * int(part.path.words[d - 1])
            self.rows.append(["node", None, part.least, self.base + d, part.least, part.n, kids, leaves, saved, ends, None, None, None, None])
            kids, ends = 1, None
        into.pending.append(len(self.rows) - 1)
        into.kids, into.leaves, into.saved = into.kids + 1, into.leaves + leaves, into.saved + saved

    def _add(self, part: Part, into: Part) -> None:
        into.n, into.least = into.n + part.n, min(into.least, part.least)
        if part.depth > into.depth:
            self._lift(part, into.depth, into)
            return
        into.kids, into.leaves, into.saved = into.kids + part.kids, into.leaves + part.leaves, into.saved + part.saved
        into.ends, into.was_open = into.ends if into.ends is not None else part.ends, into.was_open or part.was_open
        if len(into.pending) < len(part.pending):
            into.pending, part.pending = part.pending, into.pending
        into.pending.extend(part.pending)

    def _at(self, depth: int, part: Part) -> Part:
        """part if it is at this depth, else a node there that has it as its child."""
        if part.depth == depth:
            return part
        node = Part(part.path, depth, 0, part.least)
        self._add(part, node)
        return node

    def join(self, parts: list[Part], common: list[int], left: bool, right: bool) -> tuple[list[Part], list[int]]:
        """What stays open of neighbours with these common prefixes, as neighbours; all other nodes are written.

        left and right: whether more neighbours follow there. Every component that lies inside is a complete node once
        both of its outer common prefixes are smaller. A component at an open side keeps its parts in order: the outermost
        one, and for each node above it what has joined that node so far.
        """
        m = len(parts) - 1
        root, last = list(range(m + 1)), list(range(m + 1))
        own: list[Part | None] = list(parts)
        chain: dict[int, tuple[list[Part], list[int]]] = {}
        if left:
            chain[0] = ([parts[0]], [])
        if right:
            chain[m] = ([parts[m]], [])

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for edge in sorted((i for i, d in enumerate(common) if d >= 0), key=lambda i: (-common[i], i)):
            depth, a, b = common[edge], find(edge), find(edge + 1)
            open_a, open_b = chain.pop(a, None), chain.pop(b, None)
            root[b], last[a] = a, last[b]
            if open_a and open_b:
                chain[a] = (open_a[0] + open_b[0], [*open_a[1], depth, *open_b[1]])
            elif open_a:
                row, edges = open_a
                if edges and edges[-1] == depth == row[-1].depth:
                    self._add(own[b], row[-1])
                else:
                    row.append(self._at(depth, own[b]))
                    edges.append(depth)
                chain[a] = open_a
            elif open_b:
                row, edges = open_b
                node = self._at(depth, own[a])
                if edges and edges[0] == depth == row[0].depth:
                    self._add(row[0], node)
                    row[0] = node
                else:
                    row.insert(0, node)
                    edges.insert(0, depth)
                chain[a] = open_b
            else:
                own[a] = self._at(depth, own[a])
                self._add(own[b], own[a])
        open_parts, open_edges, i = [], [], 0
        while i <= m:
            at = find(i)
            if at in chain:
                if open_parts:
                    open_edges.append(-1)
                open_parts += chain[at][0]
                open_edges += chain[at][1]
            else:
                self._root(self._at(0, own[at]))
            i = last[at] + 1
        return open_parts, open_edges

    def _root(self, part: Part) -> None:
        if self.level:  # conversations that end with the block before are members too
            part.least = part.path.top
        self._finish(part)
        kind = "root" if self.level else "node"
        self.rows.append([kind, None, part.least, self.base, None, part.n, part.kids, part.leaves if part.kids else 1, part.saved, part.ends, None, None, *part.path.group])

    def hand_on(self, parts: list[Part], common: list[int], place: int) -> None:
        """Writes what is open for the task that joins it with its neighbours."""
        for part in parts:
            if part.pending:
                key = self.key(part)
                for i in part.pending:
                    self.rows[i][1], self.rows[i][4], self.rows[i][10] = place, None, key
                part.was_open, part.pending = True, []
        if parts:
            paths = [parts[0].path, parts[-1].path]
            low = common.index(min(common)) if common else 0
            known = [(int(i > low), p.depth, p.n, p.least, p.kids, p.leaves, p.saved, p.ends, p.was_open) for i, p in enumerate(parts)]
            blob = pickle.dumps((paths, known, common))
            self.rows.append(["tree", place, None, None, None, None, None, None, None, None, None, blob, None, None])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.rows), 50_000):
            columns = zip(*self.rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names=_NAMES)


def _tree(blob: bytes) -> tuple[list[Part], list[int]]:
    paths, known, common = pickle.loads(blob)
    return [Part(paths[side], depth, n, least, kids, leaves, saved, ends, was_open) for side, depth, n, least, kids, leaves, saved, ends, was_open in known], common


def _planter(level: int, block: int):
    """The forest of a task's sorted items."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts, common = Forest(level * block, level), [], []
        for batch in batches:
            for row in batch.to_pylist():
                path = Path((row["b1"], row["b2"]), row["seg"], np.array(row["words"], np.int64), row["top"])
                if parts:
                    common.append(parts[-1].path.common(path))
                parts.append(Part(path, len(path.keys) // KEY, row["n"], row["rep"], row["kids"], row["leaves"], row["saved"], row["ends"]))
        if parts:
            forest.hand_on(*forest.join(parts, common, True, True), TaskContext.get().partitionId())
        yield from forest.batches()

    return plant


def _merger(level: int, block: int, final: bool):
    """One forest of some neighbouring ones; in the end nothing stays open."""

    def merge(group: pa.Table) -> pa.Table:
        forest, parts, common = Forest(level * block, level), [], []
        for row in sorted(group.select(["place", "tree"]).to_pylist(), key=lambda r: r["place"]):
            more, edges = _tree(row["tree"])
            if parts:
                common.append(parts[-1].path.common(more[0].path))
            parts, common = parts + more, common + edges
        rest = forest.join(parts, common, not final, not final)
        if not final:
            forest.hand_on(*rest, int(group["place"][0].as_py()) // MERGED)
        return pa.Table.from_batches(list(forest.batches()), pa.schema(list(zip(_NAMES, _ARROW, strict=True))))

    return merge


def _trie(items: DataFrame, level: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, roots) of the items of one level: forests of sorted ranges, merged in a tree of tasks."""
    ordered = items.repartitionByRange("b1", "b2", "seg").sortWithinPartitions("b1", "b2", "seg")
    outs = [staged(ordered.mapInArrow(_planter(level, block), _OUT), "forests")]
    while trees := outs[-1].filter("kind = 'tree'").count():
        groups = outs[-1].filter("kind = 'tree'").withColumn("group", F.floor(F.col("place") / MERGED).cast("int"))
        final = groups.agg(F.max("group") == F.min("group")).first()[0] if trees > 1 else True
        if final:
            groups = groups.withColumn("group", F.lit(0))
        outs.append(staged(groups.groupBy("group").applyInArrow(_merger(level, block, final), _OUT), "forests"))
    every = outs[0]
    for out in outs[1:]:
        every = every.unionByName(out)
    nodes, closed = every.filter("kind = 'node'"), every.filter("kind = 'close'").select("pkey", F.col("parent").alias("__parent"))
    waiting = nodes.filter("pkey IS NOT NULL")
    # a node with very many children is looked up once for each task's share of them
    asked = waiting.select("pkey", "place").distinct().join(closed, "pkey")
    told = waiting.join(asked, ["pkey", "place"]).withColumn("parent", F.col("__parent"))
    columns = ["conv_id", "depth", "parent", "n", "kids", "leaves", "saved", "ends"]
    return nodes.filter("pkey IS NULL").select(columns).unionByName(told.select(columns)), every.filter("kind = 'root'") if level else None


def _numberer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id with their number in this part of the conversation, from 1."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        start = np.zeros(len(ids), np.int64)
        start[new] = new
        local = np.arange(len(ids)) - np.maximum.accumulate(start) + 1
        if ids[0] == last:
            local[: new[1] if len(new) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(local[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.full(len(ids), part, np.int32)), pa.array(local)], names=["conv_id", "key", "words", "part", "local"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): the turns of each conversation by number, null first, then by their key.

    Only a digest of role and text goes on. Turns are sorted over all tasks, so a conversation may have any number.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), word_count(text).cast("int").alias("words"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    cut = staged(turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "key", "words").mapInArrow(_numberer, "conv_id long, key binary, words int, part int, local long"), "turns")
    sizes = cut.groupBy("conv_id", "part").agg(F.max("local").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation of a part began in an earlier one, so these are not more rows than parts
    later = F.broadcast(sizes.withColumn("before", ahead).filter("before > 0").drop("here"))
    return cut.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuild(turns: DataFrame, family: int = 20, borrowed: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, key, words) of the rebuilt turns, d from 1, and (conv_id) of every conversation, turnless or not.

    A conversation c has the first h turns of conversation c - c % family (all if fewer, none if absent) in place of its
    own first h, where h is the unsigned CRC-32 of c in decimal, modulo borrowed.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(borrowed)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < borrowed)).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    convs = staged(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"), "conversations")
    lent = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("d"), "key", "words")
    own = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "key", "words")
    return lent.unionByName(own), convs.select("conv_id")


def _blocks(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """A row for each block of a conversation's turns, with signatures of what comes before it, after it and of all."""
    row = F.struct("d", "key", "words")
    cut = turns.withColumn("j", F.floor((F.col("d") - 1) / block).cast("int")).groupBy("conv_id", "j").agg(F.sort_array(F.collect_list(row)).alias("t"))
    seg, words = F.aggregate("t", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["key"])), F.transform("t", lambda x: x["words"])
    own = cut.select("conv_id", "j", seg.alias("seg"), words.alias("words"))
    none = convs.join(own.select("conv_id").distinct(), "conv_id", "left_anti")
    own = own.unionByName(none.select("conv_id", F.lit(0).alias("j"), F.lit(b"").cast("binary").alias("seg"), F.array().cast("array<int>").alias("words")))
    w = Window.partitionBy("conv_id").orderBy("j")
    before, whole, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    own = own.withColumns({"x1": F.xxhash64("j", "seg"), "x2": F.xxhash64("seg", "j", F.lit(7)), "w": F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)})
    found = {f"b{i}": F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)) for i in (1, 2)} | {f"f{i}": F.bit_xor(f"x{i}").over(whole) for i in (1, 2)}
    found |= {"tail": F.coalesce(F.sum("w").over(after), F.lit(0)), "last": F.col("j") == F.max("j").over(whole)}
    return own.withColumns(found).withColumns({f"a{i}": F.col(f"b{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}).drop("x1", "x2", "w")


def _items(blocks: DataFrame) -> DataFrame:
    """Equal blocks after equal turns as one; uniform if all of its conversations go on alike."""
    full = F.struct("f1", "f2")
    more = {"n": F.count(F.lit(1)), "rep": F.min("conv_id"), "seg": F.first("seg"), "words": F.first("words"), "low": F.min(full), "high": F.max(full)}
    more |= {"ends": F.min(F.when(F.col("last"), F.col("conv_id"))), "more": F.max(~F.col("last")), "tail": F.max("tail")}
    items = blocks.groupBy("b1", "b2", "a1", "a2").agg(*[c.alias(k) for k, c in more.items()])
    return items.withColumn("uniform", F.col("low") == F.col("high")).drop("low", "high")


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of later blocks of conversations that go on alike: one child each, the same members."""
    names = ["conv_id", "depth", "parent", "n", "kids", "leaves", "saved", "ends"]
    for batch in batches:
        for r in batch.to_pylist():
            words = np.array(r["words"], np.int64)
            k = len(words)
            kids, ends = np.ones(k, np.int64), [None] * k
            if r["last"]:
                kids[-1], ends[-1] = 0, r["conv_id"]
            same = np.full(k, r["conv_id"], np.int64)
            saved = (r["n"] - 1) * (np.cumsum(words[::-1])[::-1] + r["tail"])
            columns = [same, r["first"] + np.arange(k), same, np.full(k, r["n"], np.int64), kids, np.ones(k, np.int64), saved]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ends, pa.int64())], names=names)


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the joined ids of each signature; rows come in order of conv_id."""
    held: dict[tuple[int, int], list[int]] = {}
    done: list[tuple[int, int, int, str]] = []

    def flush(which: tuple[int, int]) -> None:
        ids = held.pop(which)
        done.append((*which, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for f1, f2, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = held.setdefault((f1, f2), [])
            ids.append(c)
            if len(ids) * 12 > PIECE:
                flush((f1, f2))
        if len(done) > 200:
            yield _pieces(done)
            done.clear()
    for which in list(held):
        flush(which)
    yield _pieces(done)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["f1", "f2", "first", "ids"])


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ends, sha256) of each signature; its pieces follow each other in order."""
    last, rep, digest = None, None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for f1, f2, first, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (f1, f2) != last:
                if digest:
                    done.append((rep, digest.hexdigest()))
                last, rep, digest = (f1, f2), first, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["ends", "ends_sha256"]), preserve_index=False)
            done = []
    if digest:
        done.append((rep, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["ends", "ends_sha256"]), preserve_index=False)


def _ends(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256): of equal conversations the smallest id, and the hash of all, a stream of pieces in order."""
    pieces = members.repartitionByRange("conv_id").sortWithinPartitions("conv_id").select("f1", "f2", "conv_id").mapInArrow(_joiner, "f1 long, f2 long, first long, ids string")
    return pieces.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "first").mapInArrow(_hasher, "ends long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations: the nodes of their prefix trie.

    turns has (conv_id, d, key, words), d from 1 without gaps, equal keys for equal turns; convs every conv_id once,
    with turns or without. Returned: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, words of a node's last turn
    times its members but one) and ends_sha256 (of the ascending ids of members that end there, comma-joined).

    Equal conversations count as one item. Items are sorted by their turns' keys over all tasks; each task joins sorted
    neighbours by union-find in descending order of their common prefix, where every merge makes a branching node, and
    contracts what may go on beyond its border to one part for each node above its first and its last item; forests
    of neighbouring tasks are merged in groups until one is left. A row holds one block of turns; conversations
    that differ, but share a whole block, meet again in their next block, whose trie hangs below the block's end.
    No conversations give no rows.
    """
    blocks = staged(_blocks(turns, convs, block), "blocks")
    long = bool(blocks.filter("j > 0").limit(1).count())
    levels = [staged(_items(blocks.filter("j = 0")).withColumn("top", F.lit(None).cast("long")), "items")]
    while long and (split := levels[-1].filter("NOT uniform")).limit(1).count():
        below = split.select(F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("rep").alias("top"))
        levels.append(staged(_items(blocks.filter(F.col("j") == len(levels))).join(below, ["b1", "b2"]), "items"))
    nodes: DataFrame | None = None
    roots: DataFrame | None = None
    for level in reversed(range(len(levels))):
        items = levels[level]
        alike = {"kids": F.col("more").cast("long"), "leaves": F.col("more").cast("long"), "saved": (F.col("n") - 1) * F.col("tail")}
        if roots is None:
            items = items.withColumns(alike)
        else:
            known = roots.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), *[F.col(k).alias(f"__{k}") for k in alike], F.lit(True).alias("__found"))
            items = items.join(known, ["a1", "a2"], "left").withColumns({k: F.when(F.col("__found") & ~F.col("uniform"), F.col(f"__{k}")).otherwise(c) for k, c in alike.items()})
        found, roots = _trie(items.select("b1", "b2", "seg", "words", "n", "rep", "kids", "leaves", "saved", "ends", "top"), level, block)
        if long:
            go_on = levels[level].filter("uniform AND more").select(F.col("rep").alias("conv_id"), "n")
            later = blocks.filter(F.col("j") > level).join(go_on, "conv_id").select("conv_id", (F.col("j").cast("long") * block + 1).alias("first"), "words", "tail", "last", "n")
            found = found.unionByName(later.mapInArrow(_tails, "conv_id long, depth long, parent long, n long, kids long, leaves long, saved long, ends long"))
        nodes = found if nodes is None else nodes.unionByName(found)
    nodes = staged(nodes, "trie")
    hashes = _ends(blocks.filter("last").select("conv_id", "f1", "f2"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    every = nodes.filter("ends IS NOT NULL").join(hashes, "ends").unionByName(nodes.filter("ends IS NULL").withColumn("ends_sha256", empty))
    names = {"conv_id": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "kids": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends_sha256": "ends_sha256"}
    return every.select(*[F.col(k).alias(v) for k, v in names.items()])


def conversation_trie(conversations: DataFrame, family: int = 20, borrowed: int = 4, block: int = BLOCK) -> DataFrame:
    """The prefix trie of rebuilt conversations (conv_id, turn, role, text); see rebuild and prefix_trie.

    A null role or text is empty; turns go by number, null first, equal numbers by a digest of role and text; repeated
    rows are turns of their own; rows without conv_id belong to no conversation and are left out; other columns are not
    read.
    """
    turns = staged(ordered_turns(conversations), "ordered-turns")
    rebuilt, convs = rebuild(turns, family, borrowed)
    return prefix_trie(rebuilt, convs, block)


def oracle_sql() -> str:
    """The SQL of conversation_trie(conversations): every prefix of every conversation."""
    return r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(m ORDER BY pos) AS turns FROM t GROUP BY conv_id),
hs AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS INT) AS h FROM o),
c AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS s FROM hs a LEFT JOIN o b ON b.conv_id = a.base),
p AS (SELECT conv_id, d, len(s) AS n, CAST(s[1:d] AS VARCHAR) AS node, CASE WHEN d > 0 THEN CAST(s[1:d - 1] AS VARCHAR) END AS up,
    CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(s[d].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ELSE 0 END AS w
  FROM c, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
nodes AS (SELECT d, node, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY d, node),
kids AS (SELECT up, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up, d),
-- every node's own worth once, at each of its prefixes, by its smallest member
below AS (SELECT a.d, a.node, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.up = n.node AND k.d = n.d JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.k, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.up AND u.d = n.d - 1 LEFT JOIN kids k ON k.up = n.node AND k.d = n.d
JOIN below b ON b.node = n.node AND b.d = n.d
"""
