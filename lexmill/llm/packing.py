"""Packing of token sequences: a grouping genetic algorithm on islands, over shards of the pieces of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged
from .token_files import WordEncoder

#: Tokens of a sequence, pieces of a shard, islands of a shard, solutions of an island.
CAPACITY, SHARD, ISLANDS, POPULATION = 4096, 8192, 3, 4
#: Rounds between migrations, and children of an island in each.
ROUNDS, CHILDREN = 3, 40
#: Share of a shard's pieces that go on to the next level at most: those of the bins with most room.
LEFT_OVER = 8
#: Tasks that evolve islands, where there are so many.
TASKS = 20_000
#: Bytes of text that are encoded at once, words that a worker keeps, bytes of ids that a task holds before it writes them.
_SLICE, _CACHED_WORDS, _HELD = 1 << 21, 300_000, 16 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
_ISLANDS = "shard int, island int, seed long, tags array<long>, lengths array<int>, bins array<array<int>>"


# Pieces -----------------------------------------------------------------------------------------------------------------


def _cutter(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.load(path, _CACHED_WORDS)
        pa.set_memory_pool(pa.system_memory_pool())  # which gives memory back between slices
        for whole in batches:
            doc_ids, texts = whole.columns
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())
            b = 0
            while b < len(texts):
                a, b = b, max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + _SLICE, side="right")))
                ids, sizes = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                ids, sizes = np.insert(ids, np.cumsum(sizes), np.int32(end_id)).astype("<u4"), sizes + 1
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                data = memoryview(np.ascontiguousarray(ids).tobytes())
                at = 4 * np.concatenate([[0], np.cumsum(length)])
                blobs = [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [doc_ids.slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each row's token ids with the end id, cut only where they exceed capacity.

    start counts the ids before the piece, ids are little-endian unsigned 32-bit integers. A null or empty text is its
    end id alone; null and repeated doc_ids are kept, each row with pieces of its own; no rows give none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_cutter(tokenizer, end_id, capacity), _PIECES)


# One shard ---------------------------------------------------------------------------------------------------------------


class BestFit:
    """Bins of one capacity; a length goes where the least room stays."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def open(self, number: int, room: int) -> None:
        if room:
            self.by_room[room].append(number)
            self.rooms |= 1 << room

    def place(self, length: int) -> int | None:
        """The bin with the least room that holds the length, whose room shrinks by it; None if none does."""
        fit = self.rooms >> length
        if not fit:
            return None
        room = length + (fit & -fit).bit_length() - 1
        own = self.by_room[room]
        number = own.pop()
        if not own:
            self.rooms &= ~(1 << room)
        self.open(number, room - length)
        return number


def fill(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """bins with the items in this order added: best fit among the bins there are, else a new one. -1: not placed."""
    bins = bins.copy()
    used = np.bincount(bins[bins >= 0], lengths[bins >= 0]).astype(np.int64) if (bins >= 0).any() else np.zeros(0, np.int64)
    fit = BestFit(capacity)
    for number, full in enumerate(used.tolist()):
        if full:
            fit.open(number, capacity - full)
    free = len(used)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        number = fit.place(length)
        if number is None:
            number, free = free, free + 1
            fit.open(number, capacity - length)
        bins[i] = number
    return np.unique(bins, return_inverse=True)[1]


def cost(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, the ones whose fill differs most (the squares of the fills sum to more)."""
    full = np.bincount(bins, lengths)
    return len(full), -float(((full / capacity) ** 2).sum())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer: by the sum, and by items of over half a bin with those that fit beside none of them."""
    best = -(-int(lengths.sum()) // capacity)
    ordered = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(ordered)])
    for small in np.unique(ordered[ordered <= capacity // 2]).tolist() or [0]:
        low, mid, high = (int(np.searchsorted(ordered, x, side)) for x, side in ((small, "left"), (capacity // 2, "right"), (capacity - small, "right")))
        alone, half = len(ordered) - high, high - mid
        rest = int(total[mid] - total[low]) - (half * capacity - int(total[high] - total[mid]))
        best = max(best, alone + half + max(0, -(-rest // capacity)))
    return best


def crossover(lengths: np.ndarray, mine: np.ndarray, other: np.ndarray, capacity: int, rnd: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of other enter mine whole, bins that hold their items too are dissolved, and what those
    lose is placed again by best fit, longest first, together with a few of the worst bins."""
    full = np.bincount(other, lengths) / capacity
    well = np.flatnonzero(full >= np.quantile(full, rnd.uniform(0.3, 0.9)))
    chosen = np.zeros(len(full), bool)
    chosen[well[rnd.random(len(well)) < rnd.uniform(0.1, 0.6)]] = True
    enters = chosen[other]
    own = np.bincount(mine, lengths) / capacity
    gone = np.zeros(len(own), bool)
    gone[mine[enters]] = True
    gone[np.argsort(own, kind="stable")[: int(rnd.integers(1, 4))]] = True
    child = np.where(gone[mine], -1, mine)
    child[enters] = len(own) + other[enters]
    out = np.flatnonzero(child < 0)
    order = out[np.argsort(-lengths[out], kind="stable")]
    placed = child >= 0
    child[placed] = np.unique(child[placed], return_inverse=True)[1] if placed.any() else child[placed]
    return fill(lengths, order, child, capacity)


def settle(lengths: np.ndarray, capacity: int, n: int, rnd: np.random.Generator) -> list[np.ndarray]:
    """First solutions: longest first, then by lengths that are blurred more and more."""
    none, out = np.full(len(lengths), -1), []
    for k in range(n):
        blur = lengths * (1 + 0.15 * k * rnd.standard_normal(len(lengths)))
        out.append(fill(lengths, np.argsort(-blur, kind="stable"), none, capacity))
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, children: int, rnd: np.random.Generator) -> list[np.ndarray]:
    """The population after so many children, each in place of the worst if it is better and new; best first."""
    ranked = sorted(((cost(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda r: r[:2])
    goal = least_bins(lengths, capacity)
    for k in range(children):
        if len(ranked) < 2 or ranked[0][0][0] <= goal:
            break
        a = int(rnd.integers(0, max(1, len(ranked) // 2)))
        b = int(rnd.integers(0, len(ranked) - 1))
        child = crossover(lengths, ranked[a][2], ranked[b + (b >= a)][2], capacity, rnd)
        price = cost(lengths, child, capacity)
        if price < ranked[-1][0] and all(price != r[0] for r in ranked):
            ranked[-1] = (price, len(population) + k, child)
            ranked.sort(key=lambda r: r[:2])
    return [r[2] for r in ranked]


# Islands -----------------------------------------------------------------------------------------------------------------


def _evolver(capacity: int, population: int, children: int):
    """One round of each island's row; what other islands sent is in its bins already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths = np.array(row["lengths"], np.int64)
                rnd = np.random.default_rng(int(mix(np.array([row["seed"] & ((1 << 63) - 1)], np.uint64))[0]))
                bins = [np.array(b, np.int64) for b in row["bins"]] or settle(lengths, capacity, population, rnd)
                best = evolve(lengths, bins, capacity, children, rnd)[:population]
                new = row | {"bins": [b.astype(np.int32) for b in best], "seed": row["seed"] + 1_000_003}
                yield pa.RecordBatch.from_pylist([new], batch.schema)

    return run


def islands(shards: DataFrame, count: int, capacity: int = CAPACITY, n: int = ISLANDS, population: int = POPULATION, rounds: int = ROUNDS, children: int = CHILDREN) -> DataFrame:
    """(shard, tags, lengths, bins): the best packing found for each of count rows (shard, tags, lengths).

    Every shard has n islands, whose populations evolve apart, each in a task of its own; after each round the best
    solution of an island joins the next one's population. Seeds depend on shard and island alone.
    """
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    state = shards.withColumn("island", F.explode(numbers)).select("shard", "island", (F.col("shard").cast("long") * n + F.col("island")).alias("seed"), "tags", "lengths", F.array().cast("array<array<int>>").alias("bins"))
    for k in range(rounds):
        if k:
            guests = state.select("shard", ((F.col("island") + 1) % n).alias("island"), F.col("bins")[0].alias("guest"))
            state = state.join(guests, ["shard", "island"]).withColumn("bins", F.array_append("bins", F.col("guest"))).drop("guest").select("shard", "island", "seed", "tags", "lengths", "bins")
        spread = state.repartition(min(count * n, TASKS), "shard", "island")
        state = staged(spread.mapInArrow(_evolver(capacity, population, children), _ISLANDS), "islands")
    used = F.array_max(F.col("bins")[0])
    return state.groupBy("shard").agg(F.min_by(F.struct("tags", "lengths", F.col("bins")[0].alias("bins")), F.struct(used, "island")).alias("best")).select("shard", "best.*")


def _opener(capacity: int, share: int, final: bool):
    """(tag, length, shard, bin, offset) of each item; bin is null for those of the bins with most room, unless final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths, bins = np.array(row["lengths"], np.int64), np.array(row["bins"], np.int64)
                full, items = np.bincount(bins, lengths), np.bincount(bins)
                order = np.argsort(full, kind="stable")
                order = order[full[order] < capacity]
                give = order[np.cumsum(items[order]) <= len(lengths) // share] if not final else order[:0]
                by = np.argsort(bins, kind="stable")
                offset = np.cumsum(lengths[by]) - lengths[by]
                offset -= np.repeat(offset[np.cumsum(items) - items], items)
                own = bins[by]
                columns = [np.array(row["tags"], np.int64)[by], lengths[by], np.full(len(by), row["shard"], np.int32), own.astype(np.int32), offset]
                masks = [None, None, None, np.isin(own, give), None]
                yield pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks, strict=True)], names=["tag", "length", "shard", "bin", "offset"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, share: int = LEFT_OVER, **options) -> DataFrame:
    """(tag, sequence_id, offset) of each item (tag, length): a packing into few sequences of at most capacity.

    Tags are distinct; lengths are from 1 to capacity. Items go by a hash of their tag to shards of about so many,
    which a grouping genetic algorithm packs on islands of their own. Items of the bins with most room, a share of a
    shard at most, are packed again in the next level's shards, until one shard holds all of them. Items that
    fill a sequence have one each. Offsets in a sequence have no gaps. No items give no rows.
    """
    whole = items.filter(F.col("length") == capacity).select("tag", (-F.col("tag") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, level, done = items.filter(F.col("length") < capacity).select("tag", F.col("length").cast("int").alias("length")), 0, [whole]
    while n := left.count():
        shards = max(1, -(-n // shard))
        number = F.pmod(F.xxhash64("tag", F.lit(level)), F.lit(shards)).cast("int")
        row = F.sort_array(F.collect_list(F.struct("tag", "length")))
        cut = left.groupBy(number.alias("shard")).agg(row.alias("row")).select("shard", F.col("row.tag").alias("tags"), F.col("row.length").alias("lengths"))
        found = islands(cut, shards, capacity, **options).mapInArrow(_opener(capacity, share, shards == 1), "tag long, length long, shard int, bin int, offset long")
        found = staged(found, "packed")
        # numbers of levels and shards leave room for any number of bins: level in the upper bits, then shard, then bin
        number = F.lit(level << 56) + F.shiftleft(F.col("shard").cast("long"), 20) + F.col("bin")
        done.append(found.filter("bin IS NOT NULL").select("tag", number.alias("sequence_id"), "offset"))
        left, level = found.filter("bin IS NULL").select("tag", F.col("length").cast("int").alias("length")), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) of each piece of docs; see token_pieces and pack.

    ids_crc32 is the unsigned CRC-32 of the ids as they are stored.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumns({"ids_crc32": F.crc32("ids"), "tag": F.monotonically_increasing_id()})
    pieces = staged(pieces, "pieces", **{"parquet.block.size": _HELD, "parquet.enable.dictionary#ids": "false"})
    return pieces.join(pack(pieces.select("tag", "length"), capacity, **options), "tag").drop("tag")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, a row each of capacity at most."""
    row = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    parts = packed.groupBy("sequence_id").agg(row.alias("row"))
    ids = F.aggregate("row", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.aggregate("row", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), ids.alias("ids"))
