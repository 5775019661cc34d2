"""MinHash near-duplicates with odd sketches: banded candidates, parity bitmaps, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, SLICE_BYTES, mix, random_table, span_hashes, staged
from .components import connected_components

#: 42 bands of 6 samples: a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42 = 3e-6.
BANDS, BAND_ROWS = 42, 6
SAMPLES = BANDS * BAND_ROWS
#: An odd sketch folds a set's least hashes, so many at most, into so many parity bits.
SKETCH_SAMPLES, SKETCH_BITS = 512, 2048
#: How far a sketch's estimate may be below the threshold: over four standard deviations, where all of both sets is
#: folded and where only samples are.
WHOLE_MARGIN, SAMPLED_MARGIN = 0.04, 0.12
#: Members of a bucket in one part; blocks are pairs of parts.
BLOCK = 1024
#: Rows of candidates that are broadcast at most, to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(16)]
#: Sample i of a set is the least a[i] * x + b[i] modulo 2 ** 32 of its hashes' upper halves x.
_A = (random_table(SAMPLES, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random_table(SAMPLES, 3) >> np.uint64(32)).astype(np.uint32)
_BAND_MIX = random_table(BANDS, 4)
_SET_BLOCK = 4096


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the start of each word of a UTF-8 buffer; A-Z count as a-z, white space is ASCII."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(data, starts, ends), starts


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of so many words, or all words of a shorter text."""
    at = 0
    while at < len(texts):
        parts, sizes, room = [], [], SLICE_BYTES
        while at < len(texts) and (room > 0 or not parts):
            part = (texts[at] or "").encode("utf-8", "surrogatepass")
            parts.append(part)
            sizes.append(len(part) + 1)
            room -= len(part) + 1
            at += 1
        hashes, starts = word_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for i in range(words if len(runs) else 0):
            runs = runs * _STEPS[1] + hashes[i : i + len(runs)]
        runs = mix(runs)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                short = reduce(lambda x, y: x * _STEPS[1] + y, hashes[a:b], np.uint64(b - a))
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLES MinHash samples of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _SET_BLOCK):
        values = np.multiply.outer(_A, x[i : i + _SET_BLOCK])
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band of samples, different between bands."""
    rows = samples.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, np.uint64)
    for i in range(BAND_ROWS):
        key = mix(key ^ rows[:, i])
    return mix(key ^ _BAND_MIX).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> bytes:
    """The parity bitmap of a sorted set's least hashes: each flips one bit."""
    bit = (mix(shingles[:SKETCH_SAMPLES]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def sketch_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The Jaccard similarities that pairs of odd sketches (rows of uint64) and set sizes estimate.

    d = -bits / 2 * ln(1 - 2 flipped / bits) samples are in one of the sketches alone, so (a + b - d) / 2 of their a
    and b samples are common; samples are all hashes below a threshold, at which the common part of the sets is cut.
    """
    flipped = np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)
    apart = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * flipped / SKETCH_BITS, 1e-9))
    a, b = np.minimum(n_left, SKETCH_SAMPLES), np.minimum(n_right, SKETCH_SAMPLES)
    share = np.minimum(a / np.maximum(n_left, 1), b / np.maximum(n_right, 1))
    both = np.maximum(a + b - apart, 0) / 2 / np.maximum(share, 1e-9)
    return both / np.maximum(n_left + n_right - both, 1e-9)


def may_link(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked by their sizes and sketches."""
    margin = np.where(np.maximum(n_left, n_right) <= SKETCH_SAMPLES, WHOLE_MARGIN, SAMPLED_MARGIN)
    sized = 100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right)
    return sized & (sketch_similarity(left, right, n_left, n_right) >= percent / 100 - margin)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


_SIGNATURE = "doc_id long, text_id long, n_shingles long, set_id binary, bands array<long>, sketch binary"


def _signatures(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, bands, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for shingles in shingle_sets(batch.column(2).to_pylist(), words):
                    sizes.append(len(shingles))
                    some = len(shingles) > 0
                    ids.append(np.array([mix(shingles).sum(), np.bitwise_xor.reduce(mix(shingles ^ _BAND_MIX[0]))], np.uint64).tobytes() if some else None)
                    bands.append(band_keys(minhash(shingles)) if some else None)
                    sketches.append(odd_sketch(shingles) if some else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "n_shingles", "set_id", "bands", "sketch"])

    return sign


def _sets(words: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = [x.tobytes() for x in shingle_sets(batch.column(1).to_pylist(), words)]
            for i in range(0, len(sets), 64):
                part = sets[i : i + 64]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(part, pa.binary())], names=["id", "shingles"])

    return hashed


def _sketched(percent: int):
    """Keeps the pairs (a, b, na, nb, sa, sb) that may be linked."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            near = may_link(_sketches(batch.column(4)), _sketches(batch.column(5)), na, nb, percent)
            yield batch.select([0, 1]).filter(pa.array(near))

    return keep


def _crossing(percent: int):
    """Streams blocks of a bucket's members, ordered by block, and yields the pairs across components that may be linked.

    A pair that shares several buckets is looked at in the first of its bands alone. In a block of two parts, pairs
    within a part are left to that part's own block.
    """

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        ids, comps, sizes = (block.column(x).to_numpy() for x in ("id", "component", "n_shingles"))
        in_low = pa.compute.equal(block.column("part"), block.column("low")).to_numpy(zero_copy_only=False)
        band, bands = block.column("band")[0].as_py(), np.stack(block.column("bands").to_numpy(zero_copy_only=False))
        sketches = _sketches(block.column("sketch"))
        one = block.column("low")[0].as_py() == block.column("high")[0].as_py()
        a, b = [], []
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids))
            j = j[(comps[j] != comps[i]) & (one | (in_low[j] != in_low[i]))]
            j = j[may_link(sketches[j], sketches[i], sizes[j], np.full(len(j), sizes[i]), percent)]
            if len(j):
                same = bands[j] == bands[i]
                j = j[bands[i][same.argmax(axis=1)] == band]
                a.append(np.full(len(j), ids[i]))
                b.append(ids[j])
            if len(a) > 1000 or i == len(ids) - 1:
                x, y = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                a, b = [], []

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("band", "low", "high")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and at != keys[i]:
                    yield from pairs(held)
                    held = []
                at = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from pairs(held)

    return cross


def _confirm(percent: int):
    """Streams (pivot, part, member, shingles), each pivot's own set before its members', and keeps the true links."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for pivot, part, member, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                if member.as_py() is None:
                    at, own = (pivot.as_py(), part.as_py()), shingles.copy()
                    continue
                assert at == (pivot.as_py(), part.as_py())
                both = len(np.intersect1d(own, shingles, assume_unique=True)) if 100 * min(len(own), len(shingles)) >= percent * max(len(own), len(shingles)) else 0
                if 100 * both >= percent * (len(own) + len(shingles) - both):
                    a.append(pivot.as_py())
                    b.append(member.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm


def _confirmed(near: DataFrame, texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of near whose full sets are linked. Each class's set is made once, of the text of one of its
    rows, and moved once for each pair's b and for each a and 64th of its partners."""
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    ids = staged(classes.select("id", "doc_id", "text_id").join(ids, "id", "left_semi"), "near-ids")
    found = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["doc_id", "text_id"])
    one = found.groupBy("id").agg(F.first("text").alias("text"))  # rows may repeat
    sets = staged(one.mapInArrow(_sets(words), "id long, shingles binary"), "sets")
    near = near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)))
    members = near.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.col("b").alias("member"), "shingles")
    pivots = near.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("member"), "shingles")
    rows = pivots.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("member").asc_nulls_first())
    return staged(rows.mapInArrow(_confirm(percent), "a long, b long"), "links")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """members (band, id, component, ...) in blocks, the pairs (low, high) of parts of a band, as often as they meet others.

    A component of at least block members has parts of its own, smaller ones share parts; two parts of one component
    never meet. So a band of one great component and few others moves each member about once.
    """
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.groupBy("band").agg(F.coalesce(F.sum(F.when(F.col("n") < block, F.col("n"))), F.lit(0)).alias("rest"))
    owned = F.when(F.col("n") >= block, F.col("component"))
    own_part = F.concat(F.lit("c"), F.col("component"), F.lit(":"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.greatest(F.ceil(F.col("rest") / block), F.lit(1))))
    placed = members.join(sizes, ["band", "component"]).join(small, "band").withColumn("owner", owned)
    placed = staged(placed.withColumn("part", F.when(F.col("owner").isNotNull(), own_part).otherwise(shared)).drop("n", "rest"), "bucket-parts")
    parts = placed.groupBy("band", "part", "owner").agg(F.count(F.lit(1)).alias("n"))
    low, high = (parts.select("band", F.col("part").alias(x), F.col("owner").alias(f"{x}_owner")) for x in ("low", "high"))
    one_owner = F.coalesce(F.col("low_owner") == F.col("high_owner"), F.lit(False))
    meets = staged(low.join(high, "band").filter((F.col("low") <= F.col("high")) & ~one_owner).select("band", "low", "high"), "bucket-blocks")
    as_low = placed.join(meets.withColumn("part", F.col("low")), ["band", "part"])
    as_high = placed.join(meets.filter("low <> high").withColumn("part", F.col("high")), ["band", "part"])
    return as_low.unionByName(as_high).drop("owner")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_id, group_id) of each row of docs, by the similarity of the sets of word shingles.

    A text's set holds its distinct runs of so many words, A-Z counting as a-z and words parted by ASCII white space;
    a shorter text is one run; null, empty and blank texts have none. Texts are linked when 100 times the sets'
    intersection is at least percent times their union. component_id is the smallest doc_id reachable by links, kept
    is doc_id = component_id. Rows without a set, or without doc_id, are linked with nothing and kept. Rows with
    equal sets count as one class. Rows that share a doc_id are judged each by its own text; text_id, the xxhash64 of the
    text, tells them apart, and group_id, a number without meaning, which of them are linked. An empty table gives an empty result; other columns of docs are not read.

    Steps: (1) classes of equal sets; (2) band keys of each class's MinHash samples, and in each bucket the pairs of
    its smallest member, the pivot, with the others; (3) the odd sketches' estimate, then the full sets, confirm
    links; (4) components; (5) buckets whose other members still lie in several components are compared in blocks by
    their sketches, and what may be linked across components is confirmed likewise. Every pair of a bucket is thus
    either confirmed, refuted or already connected.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    signed = staged(texts.mapInArrow(_signatures(words), _SIGNATURE), "signatures")
    whole = signed.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("text_id", "n_shingles", "bands", "sketch"), "doc_id").alias("x")
    classes = whole.groupBy("set_id").agg(first, F.min("doc_id").alias("doc_id"))
    classes = staged(classes.select("set_id", F.monotonically_increasing_id().alias("id"), "doc_id", "x.*"), "classes")

    banded = classes.select("id", F.explode("bands").alias("band"))
    pivots = staged(banded.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "pivots")
    buckets = staged(banded.join(pivots, "band").filter("id <> pivot").select("band", "pivot", "id"), "buckets")
    pairs = staged(buckets.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sides = [classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    sketched = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb")
    links = _confirmed(staged(sketched.mapInArrow(_sketched(percent), "a long, b long"), "near-pairs"), texts, classes, words, percent)
    component = staged(connected_components(links), "components")

    named = buckets.join(component.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    named = staged(named, "named-buckets")
    spread = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = staged(spread.filter("x <> y").select("band"), "mixed-buckets")
    if mixed.limit(1).count():
        left = _blocks(named.join(mixed, "band"), BLOCK).join(classes.select("id", "n_shingles", "bands", "sketch"), "id")
        blocks = left.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
        across = staged(blocks.mapInArrow(_crossing(percent), "a long, b long"), "near-pairs")
        if across.limit(1).count():
            links = links.unionByName(_confirmed(across, texts, classes, words, percent))
            component = staged(connected_components(links), "components")

    linked = component.join(classes.select(F.col("id").alias("node"), "set_id", "doc_id"), "node")
    homes = linked.groupBy("component").agg(F.min("doc_id").alias("home"))
    homes = staged(linked.join(homes, "component").select("set_id", "home", "component"), "set-homes")
    ids = classes.select("set_id", "doc_id", "id").join(homes, "set_id", "left").select("set_id", F.coalesce("home", "doc_id").alias("home"), F.coalesce("component", "id").alias("group_id"))
    placed = signed.select("doc_id", "text_id", "n_shingles", "set_id").join(staged(ids, "class-homes"), "set_id", "left")
    home = F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id"))
    return placed.select("doc_id", "n_shingles", home.alias("component_id"), F.coalesce(F.col("doc_id") == home, F.lit(True)).alias("kept"), "text_id", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"))
