"""Document fingerprints by winnowing, and their likeness to edited and neighbouring texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: A shared passage of GRAM + WINDOW - 1 code points always shares a selected hash; none shorter than GRAM does.
GRAM, WINDOW = 16, 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """The 32-bit hash of each run of gram code points, by doubling: a run is two halves, plus one point if odd."""
    single = mix(points.astype(np.uint64))
    hashes, length = single, 1
    for bit in bin(gram)[3:]:
        step = np.uint64(pow(int(_BASE), length, 1 << 64))
        hashes = hashes[: len(hashes) - length] * step + hashes[length:]
        length *= 2
        if bit == "1":
            hashes = hashes[:-1] * _BASE + single[length : length + len(hashes) - 1]
            length += 1
    return (mix(hashes) >> np.uint64(32)).astype(np.uint32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint: the least hash of every window of grams, the rightmost of equal ones.

    A text of fewer than gram code points is one gram; fewer grams than a window are one window; an empty text has an
    empty fingerprint. Positions rise, and neighbours are at most window apart.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = gram_hashes(points, min(gram, len(points)))
    at = np.arange(len(hashes), dtype=np.uint64)
    least = hashes.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - at)
    window, covered = min(window, len(least)), 1
    while 2 * covered <= window:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < window:
        least = np.minimum(least[: len(least) - (window - covered)], least[window - covered :])
    chosen = least[np.append(True, least[1:] != least[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits for each selected gram: eight of its hash, two of its distance from the one before.

    The first distance is the position itself, below window; window is at most 255.
    """
    rows = np.empty((len(hashes), 5), np.uint8)
    rows[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of the sets of hashes; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(rows: list[tuple[int | None, str, np.ndarray, np.ndarray, str, np.ndarray]]) -> pa.RecordBatch:
    """The result of (doc_id, text, its hashes and positions, the next text, its hashes)."""
    out: list[list] = [[] for _ in _NAMES]
    for doc_id, text, hashes, positions, following, next_hashes in rows:
        edited = edited_text(text, following)
        e_hashes, e_positions = winnow(edited)
        row = (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_string(hashes, positions),
            as_string(e_hashes, e_positions),
            likeness(hashes, e_hashes),
            likeness(hashes, next_hashes),
        )
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=_NAMES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each row (place, guest, doc_id, text) with the row after it; each place ends with a guest row, the
    next place's first text, which has no result here."""
    pending = None
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            batch = whole.slice(i, 64)
            rows = []
            for guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                current = (doc_id, text or "", *winnow(text or ""))
                if pending is not None:
                    rows.append((*pending, current[1], current[2]))
                pending = None if guest else current
            yield _compared(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The next document is the one that follows by descending doc_id, of the last one the first; rows that share a
    doc_id follow each other by the hash of their text, a null doc_id counts as the smallest long. Null texts are
    empty ones; an empty fingerprint is like another by 1 and like any other by 0; one row alone is its own next. Equal
    texts have equal fingerprints. An empty table gives an empty result; other columns of docs are not read.

    Quantiles of doc_id cut the rows into places, four for each shuffle partition; a place is streamed in order. The
    first text of each place is also sent to the place before it, so the texts are shuffled once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", [i / (4 * n) for i in range(1, 4 * n)], 1 / (16 * n))
    bounds = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-bounds[::-1], -keys.to_numpy(np.float64)).astype(np.int32))

    firsts = sorted((r.place, r.key) for r in rows.groupBy(place("key").alias("place")).agg(F.max("key").alias("key")).toLocalIterator())
    after = [(a[0], b[1]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(after, "place int, key long"))  # at most four rows a shuffle partition
    found = rows.join(wanted, "key").groupBy("place", "key").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("x"))
    guests = found.select("place", F.lit(True).alias("guest"), "key", F.lit(None).cast("long").alias("doc_id"), "x.text")
    placed = rows.select(place("key").alias("place"), F.lit(False).alias("guest"), "key", "doc_id", "text").unionByName(guests)
    order = ["place", "guest", F.col("key").desc(), F.xxhash64("text")]
    streamed = placed.repartition(n, "place").sortWithinPartitions(*order).select("place", "guest", "doc_id", "text")
    return streamed.mapInArrow(_stream, _RESULT)
