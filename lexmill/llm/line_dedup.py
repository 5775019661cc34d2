"""Line dedup: a once-seen and a twice-seen Bloom filter find suspected repeats, and only those are counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, mix, span_hashes, staged, text_slices

#: White space that a key loses at both ends, and letters that it holds in lower case (ASCII alone).
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bits for each key, probes, and bits of a segment; all probes of a key are in its segment.
KEY_BITS, PROBES, SEGMENT_BITS = 16, 4, 16
#: Hashes of a range for which one once-seen filter is built, and hashes that a task holds before it hands them on.
RANGE_HASHES, HELD_HASHES = 1 << 19, 1 << 20
#: Bits of the twice-seen filter that are broadcast at most (32 MB); a larger one stays with tasks, a segment each, and
#: hashes go to it.
BROADCAST_BITS = 1 << 28


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(_STRIP).translate(_LOWER)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the key of each line of texts in a UTF-8 buffer; a text has one line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets[1:], breaks, side="right")
    many = np.bincount(owner, minlength=len(offsets) - 1) + 1
    last = np.cumsum(many) - 1
    starts, ends = np.empty(int(many.sum()), np.int64), np.empty(int(many.sum()), np.int64)
    starts[last - many + 1], ends[last] = offsets[:-1], offsets[1:]
    at = np.arange(len(breaks)) + owner
    ends[at], starts[at + 1] = breaks, breaks + 1
    solid = np.flatnonzero(~IS_SPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = low < high
    starts[some], ends[some] = solid[low[some]], solid[high[some] - 1] + 1
    ends[~some] = starts[~some]
    return np.repeat(np.arange(len(many)), many), starts, ends


def _long_enough(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> np.ndarray:
    if min_chars <= 1:
        return ends - starts >= min_chars
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points[ends] - points[starts] >= min_chars


def _text_keys(texts: pa.Array, min_chars: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the first, bytes, text, hash, start, end) of the distinct keys of each text, a run of texts at a time."""
    for row, data, offsets in text_slices(texts):
        text, starts, ends = line_spans(data, offsets)
        good = _long_enough(data, starts, ends, min_chars)
        text, starts, ends = text[good], starts[good], ends[good]
        hashes = span_hashes(data, starts, ends)
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
        order = order[new]
        yield row, data, text[new], hashes[new], starts[order], ends[order]


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bits below 2 ** bits of each hash, as a row each."""
    with np.errstate(over="ignore"):
        return np.stack([(mix(hashes + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(1, PROBES + 1)])


class Bloom:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(1 << bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        self.data[_bits(hashes, self.bits).ravel()] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.data[_bits(hashes, self.bits)].all(axis=0)


def _twice_at_most(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each hash as often as given but twice at most."""
    values, n = np.unique(hashes, return_counts=True)
    return np.repeat(values, np.minimum(n, 2))


def _hashed(min_chars: int):
    """The hashes of the keys of a task's texts, each once a text and twice at most for HELD_HASHES of them."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            values = held[0] if held else np.zeros(0, np.uint64)
            for i in range(0, len(values), 1 << 16):
                part = values[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["n", "hashes"])
            held.clear()

        for batch in batches:
            for _, _, _, hashes, _, _ in _text_keys(batch.column(0), min_chars):
                held.append(hashes)
                if sum(map(len, held)) > 2 * HELD_HASHES:
                    held[:] = [_twice_at_most(np.concatenate(held))]
                    if len(held[0]) > HELD_HASHES:
                        yield from hand_on()
        if held:
            held[:] = [_twice_at_most(np.concatenate(held))]
        yield from hand_on()

    return see


def _dealt(bits: int, salt: int):
    """Rows (part, hashes) of hashes by the first bits of their own mix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("hashes").to_pylist():
                hashes = np.frombuffer(data, np.uint64)
                with np.errstate(over="ignore"):
                    part = (mix(hashes ^ np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                order = np.argsort(part, kind="stable")
                names, starts = np.unique(part[order], return_index=True)
                own = [x.tobytes() for x in np.split(hashes[order], starts[1:])] if len(names) else []
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own, pa.binary())], names=["part", "hashes"])

    return deal


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(part, hashes) of each row, as rows come ordered by part."""
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            yield part, np.frombuffer(data, np.uint64)


def _seen_again(bits: int):
    """Rows (n, hashes): what each range's once-seen filter held already when it came again."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, []

        def done() -> pa.RecordBatch:
            values = np.unique(np.concatenate([np.zeros(0, np.uint64), *twice]))
            return pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["n", "hashes"])

        for part, hashes in _by_part(batches):
            if part != at:
                if at is not None:
                    yield done()
                at, once, twice = part, Bloom(bits), []
            values, n = np.unique(hashes, return_counts=True)
            seen = once.has(values) | (n > 1)
            twice.append(values[seen])
            once.add(values)
        if at is not None:
            yield done()

    return again


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, bits): each segment of the twice-seen filter."""
    at, own = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(own.data, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    for part, hashes in _by_part(batches):
        if part != at:
            if at is not None:
                yield done()
            at, own = part, Bloom(SEGMENT_BITS)
        own.add(hashes)
    if at is not None:
        yield done()


def _deal(hashes: DataFrame, bits: int, salt: int) -> DataFrame:
    return hashes.mapInArrow(_dealt(bits, salt), "part long, hashes binary").repartition("part").sortWithinPartitions("part")


def repeated_hashes(docs: DataFrame, min_chars: int = 1) -> tuple[DataFrame, int]:
    """Rows (n, hashes) of the hashes of keys that two texts seem to hold, and how many they are.

    All hashes are counted first; each range of about RANGE_HASHES of them has a once-seen filter of KEY_BITS a hash,
    and a hash that its filter holds already goes to the twice-seen ones.
    """
    seen = staged(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_hashed(min_chars), "n long, hashes binary"), "line-hashes")
    n = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(0, (max(1, n) - 1) // RANGE_HASHES).bit_length()
    bits = max(10, (KEY_BITS * min(max(n, 1), RANGE_HASHES) - 1).bit_length())
    twice = staged(_deal(seen, ranges, 1).mapInArrow(_seen_again(bits), "n long, hashes binary"), "repeated-hashes")
    return twice, twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def twice_filter(twice: DataFrame, n: int) -> np.ndarray:
    """The twice-seen filter of n hashes: 2 ** SEGMENT_BITS bits in bytes for each of its segments, made by tasks."""
    bits = max(0, (KEY_BITS * max(1, n) - 1) >> SEGMENT_BITS).bit_length()
    out = np.zeros((1 << bits, 1 << (SEGMENT_BITS - 3)), np.uint8)
    for row in _deal(twice, bits, 2).mapInArrow(_segments, "part long, bits binary").toLocalIterator():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter of twice_filter holds each hash."""
    segments = (len(bits) - 1).bit_length()
    with np.errstate(over="ignore"):
        part = (mix(hashes ^ np.uint64(2)) >> np.uint64(64 - segments)).astype(np.int64) if segments else np.zeros(len(hashes), np.int64)
    at = _bits(hashes, SEGMENT_BITS)
    return ((bits[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


_KEYS = "doc_id long, text_id long, hash long, key string"
_PROBES = "part long, probe boolean, doc_id long, text_id long, hashes binary"


def _key_rows(batch: pa.RecordBatch, min_chars: int, wanted) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_id, hash, key) of the keys of rows (doc_id, text_id, text) that wanted(row, text, hashes) tells."""
    for row, data, text, hashes, starts, ends in _text_keys(batch.column(2), min_chars):
        hit = np.flatnonzero(wanted(row, text, hashes))
        whole = data.tobytes()
        keys = [whole[a:b].lower().decode() for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
        take = pa.array(row + text[hit])
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes[hit].view(np.int64)), pa.array(keys, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "hash", "key"])


def _keys(filters, min_chars: int):
    """The keys of each row that the twice-seen filter has, each once a row, with their hashes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filters.value
        for batch in batches:
            yield from _key_rows(batch, min_chars, lambda row, text, hashes: in_filter(bits, hashes))

    return found


def _probing(min_chars: int, bits: int):
    """Rows (part, probe, doc_id, text_id, hashes): the hashes of each row's keys by the segment that may hold them."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, text, hashes, _, _ in _text_keys(batch.column(2), min_chars):
                part = _segment(hashes, bits)
                order = np.lexsort((part, text))
                text, part, hashes = text[order], part[order], hashes[order]
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (part[1:] != part[:-1]))) if len(text) else np.zeros(0, np.int64)
                data, at = hashes.tobytes(), 8 * np.append(first, len(hashes))
                blobs = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                take = pa.array(row + text[first])
                columns = [pa.array(part[first]), pa.array(np.ones(len(first), bool)), batch.column(0).take(take), batch.column(1).take(take), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "probe", "doc_id", "text_id", "hashes"])

    return probe


def _segment(hashes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes ^ np.uint64(3)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _tested(bits: int):
    """(doc_id, text_id, hashes) of the probes that the twice-seen filter has; each part's filter comes before its probes."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Bloom(bits)
        for batch in batches:
            parts, probes = batch.column("part").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            if not len(parts):
                continue
            cuts = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (probes[1:] != probes[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
                if parts[a] != at:
                    at, own = parts[a], Bloom(bits)
                blobs = batch.column("hashes").slice(a, b - a).to_pylist()
                hashes = np.frombuffer(b"".join(blobs), np.uint64)
                if not probes[a]:
                    own.add(hashes)
                    continue
                row = np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
                hit = own.has(hashes)
                rows, first = np.unique(row[hit], return_index=True)
                found = [x.tobytes() for x in np.split(hashes[hit], first[1:])] if len(rows) else []
                take = pa.array(a + rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_id").take(take), pa.array(found, pa.binary())], names=["doc_id", "text_id", "hashes"])

    return test


def _suspected(min_chars: int):
    """The keys of rows (doc_id, text_id, text, found) whose hashes are among those found for the row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column(3).to_pylist()]
            size = np.array([len(x) for x in found])
            owner, values = np.repeat(np.arange(len(found)), size), np.concatenate([np.zeros(0, np.uint64), *found])
            known = np.unique(mix(values ^ mix(owner.astype(np.uint64))))
            yield from _key_rows(batch, min_chars, lambda row, text, hashes, known=known: np.isin(mix(hashes ^ mix((row + text).astype(np.uint64))), known))

    return keys


def _suspects(docs: DataFrame, twice: DataFrame, n: int, min_chars: int) -> DataFrame:
    """The keys of docs that the twice-seen filter has, when it is too large for one machine.

    The filter lies in segments of about RANGE_HASHES hashes, one at a time in a task. Rows send the 8 bytes of each of
    their keys' hashes to its segment; what passes comes back to its row, and only rows with a suspect send their text.
    """
    ranges = max(0, (max(1, n) - 1) // RANGE_HASHES).bit_length()
    bits = max(10, (KEY_BITS * min(max(n, 1), RANGE_HASHES) - 1).bit_length())
    none = [F.lit(None).cast("long").alias(x) for x in ("doc_id", "text_id")]
    hashes = twice.mapInArrow(_dealt(ranges, 3), "part long, hashes binary").select("part", F.lit(False).alias("probe"), *none, "hashes")
    probes = _named(docs).mapInArrow(_probing(min_chars, ranges), _PROBES)
    met = hashes.unionByName(probes).repartition("part").sortWithinPartitions("part", "probe")
    passed = met.mapInArrow(_tested(bits), "doc_id long, text_id long, hashes binary")
    mine = staged(passed.groupBy("doc_id", "text_id").agg(F.collect_set("hashes").alias("found")), "suspect-hashes")
    mine = mine.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id"), "found")
    rows = _named(docs).join(mine, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_id") == F.col("__text_id"))).select("doc_id", "text_id", "text", "found")
    return rows.mapInArrow(_suspected(min_chars), _KEYS)


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, long_words: int | None = None, long_docs: int = 2) -> DataFrame:
    """(doc_id, text_id, key, first): for each row, by doc_id and the xxhash64 of its text, its keys of at least
    min_chars code points that at least min_docs rows of docs hold, or long_docs rows if the key has long_words words
    or more; first is the smallest doc_id that holds it.

    Suspects pass the twice-seen filter; they alone are shuffled, and counted by the key itself. A key that very many
    rows hold is counted before the shuffle, and joined to its rows under one of 16 salts.
    """
    spark = docs.sparkSession
    twice, n = repeated_hashes(docs, min_chars)
    if KEY_BITS * n <= BROADCAST_BITS:
        filters = spark.sparkContext.broadcast(twice_filter(twice, n))
        suspects = staged(_named(docs).mapInArrow(_keys(filters, min_chars), _KEYS), "suspects")
        filters.unpersist()
    else:
        suspects = staged(_suspects(docs, twice, n, min_chars), "suspects")
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    least = F.lit(min_docs)
    if long_words is not None:
        least = F.when(F.size(F.split("key", r"[\x20\x09-\x0D]+")) >= long_words, F.lit(long_docs)).otherwise(least)
    repeated = staged(counted.filter(F.col("n") >= least).select("key", "first"), "repeated-keys")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = suspects.withColumn("salt", F.pmod(F.hash("doc_id", "text_id"), F.lit(16)))
    return rows.join(salted, ["key", "salt"]).select("doc_id", "text_id", "key", "first")


def _apply(keep_first: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_lines, n_dropped, kept = [], [], []
            for doc_id, text, drops in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("__drops").to_pylist(), strict=True):
                if not drops:
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                firsts = {x["key"]: x["first"] for x in drops}
                lines = text.split("\n")
                # only a line as long as some key, blanks apart, can be that key
                sizes = {len(k) for k in firsts}
                left = []
                for line in lines:
                    bare = line.strip(_STRIP)
                    key = bare.translate(_LOWER) if len(bare) in sizes else None
                    if key is None or key not in firsts:
                        left.append(line)
                    elif keep_first and doc_id is not None and firsts[key] == doc_id:
                        left.append(line)
                        firsts[key] = None
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            columns = {x: batch.column(x) for x in names if x != "__drops"}
            columns |= {"text": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return clean


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 1, min_docs: int = 2, keep_first: bool = False, long_words: int | None = None, long_docs: int = 2
) -> DataFrame:
    """docs with the lines of each text that repeat in at least min_docs rows gone, and n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z in lower case; keys of fewer than min_chars code points
    never repeat. If long_words is given, a key of so many words or more repeats in long_docs rows already (two at
    least). A repeated key loses its lines everywhere, or everywhere but its first line in the row with the
    smallest doc_id if keep_first. The lines that stay are joined by newlines. A null text, like an empty one, is one
    empty line and stays as it is. Each row counts as a document, repeated rows too; a null doc_id is never first. An
    empty table gives an empty result. Columns n_lines and n_dropped of docs are replaced, all others stay.
    """
    docs = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    drops = repeated_keys(docs, min_chars, min_docs, long_words, long_docs).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("key", "first")).alias("__drops"))
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id"), "__drops")
    held = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text_id")), "left").drop("__id", "__text_id")
    fields = [f"`{name}` {kind}" for name, kind in docs.dtypes]
    return held.mapInArrow(_apply(keep_first), ", ".join([*fields, "n_lines long", "n_dropped long"]))


def digest(cleaned: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
