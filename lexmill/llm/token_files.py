"""Token ids as ORC files: run-length encoded stripes in document order, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import codecs
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Flat, ranges, row_slices, span_hashes

#: What a file's rows are: the file's number, the document, the ids of the file's documents before it, its ids.
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, tokens array<int>"
#: Words whose ids a worker keeps from task to task (about 50 bytes each), when they are more it starts anew, and
#: characters that it encodes at once, and bytes of words that it hashes at once.
_CACHED_WORDS, _SLICE, _HASHED = 800_000, 1 << 22, 1 << 15
#: Marks that may follow a run of letters and are a pre-token of their own.
_TAIL = string.punctuation
#: The character that a byte-level tokenizer has for each byte: itself where it is printable, else the next free one.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: The same as a table by byte, with the space as it is, so that words can be joined by it.
_CHAR_OF_BYTE = "".join(chr(b if b == 0x20 else _BYTE_CHARS.get(b, b)) for b in range(256))

_loaded: dict[str, WordEncoder] = {}


def _lower(text: str) -> str:
    """The text in lower case, as the tokenizer makes it anyway, or as it is where the order of its steps could matter."""
    return text if "\u03a3" in text or "\u0130" in text or "<|" in text or not unicodedata.is_normalized("NFC", text) else text.lower()


def _is_plain(letter: str) -> bool:
    """Whether a character is a letter that the tokenizer's normalizer leaves as it is, whatever stands beside it."""
    return letter.isalpha() and letter.lower() == letter and unicodedata.is_normalized("NFC", letter)


#: Words of such letters alone; below U+0600 no letter composes with one before it.
_PLAIN = "^[" + "".join(f"\\x{{{c:x}}}" for c in range(0x600) if _is_plain(chr(c))) + "]+$"


def _as_chars(words: pa.Array) -> list[str]:
    """The words with a character for each byte, as a byte-level model has them; no word holds a space."""
    joined = pa.compute.binary_join_element_wise(words, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
    data, offsets = _bytes_of(joined)
    return codecs.charmap_decode(data[offsets[0] : offsets[-1]], "strict", _CHAR_OF_BYTE)[0].split(" ")[:-1]


def _hashes_of(words: pa.Array) -> np.ndarray:
    """A hash of each word, of _HASHED bytes of words at a time."""
    data, offsets = _bytes_of(words)
    out, a = np.zeros(len(words), np.uint64), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _HASHED, side="right")) - 1)
        at = offsets[a : b + 1] - offsets[a]
        out[a:b] = span_hashes(data[offsets[a] : offsets[b]], at[:-1], at[1:], lower=False)
        a = b
    return out


def _tails(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each word's head."""
    data, offsets = _bytes_of(words)
    sizes = np.diff(offsets) - pa.compute.binary_length(heads).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(data[ranges(offsets[1:] - sizes, sizes)]))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of large strings and where each begins and ends."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets


class WordEncoder:
    """Encodes texts with a byte-level tokenizers file that lower-cases and whose tokens never cross white space, keeping
    words' ids.

    Texts are cut at spaces and newlines alone, where the pre-tokenizer cuts anyway, so the ids are those of the
    whole text. The distinct words of many texts are looked up once, by their hash and then their bytes; a word takes
    about 50 bytes, as its bytes and ids are in flat arrays.
    """

    def __init__(self, path: str, cached: int = _CACHED_WORDS):
        self._cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def load(cls, path: str, cached: int = _CACHED_WORDS) -> WordEncoder:
        """The encoder of a file, read once in each worker; it keeps about so many words."""
        if path not in _loaded:
            _loaded[path] = cls(path, cached)
        return _loaded[path]

    def _clear(self) -> None:
        # words by number: their bytes and ids, each in one flat array; hashes in order with the number of each
        self._hashes, self._of_hash = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._bytes, self._byte_ends = Flat(np.uint8), Flat(np.int64)
        self._ids, self._ends = Flat(np.int32), Flat(np.int64)
        self._byte_ends.add(np.zeros(1, np.int64))
        self._ends.add(np.zeros(1, np.int64))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self._ends.all[numbers]
        sizes = self._ends.all[numbers + 1] - first
        return self._ids.all[ranges(first, sizes)], sizes

    def _find(self, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The numbers of words, of equal hashes only the first is found; -1 where the bytes are not those of a known word."""
        out = np.full(len(hashes), -1)
        if not len(self._hashes):
            return out
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        may = np.flatnonzero(self._hashes[at] == hashes)
        number, sizes = self._of_hash[at[may]].astype(np.int64), offsets[may + 1] - offsets[may]
        first = self._byte_ends.all[number]
        alike = self._byte_ends.all[number + 1] - first == sizes
        may, number, first, sizes = may[alike], number[alike], first[alike], sizes[alike]
        differ = data[ranges(offsets[may], sizes)] != self._bytes.all[ranges(first, sizes)]
        total = np.concatenate([[0], np.cumsum(differ)])
        ends = np.cumsum(sizes)
        same = total[ends] == total[ends - sizes]
        out[may[same]] = number[same]
        return out

    def _add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keeps these words; their numbers."""
        known = self._ends.size - 1
        numbers = np.arange(known, known + len(words))
        data, offsets = _bytes_of(words)
        self._byte_ends.add(self._bytes.size + offsets[1:] - offsets[0])
        self._bytes.add(data[offsets[0] : offsets[-1]])
        self._ends.add(self._ids.size + np.cumsum(sizes))
        self._ids.add(ids)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self._hashes, hashes[order])
        self._hashes = np.insert(self._hashes, at, hashes[order])
        self._of_hash = np.insert(self._of_hash, at, numbers[order])
        return numbers

    def _by_model(self, words: pa.Array) -> tuple[list[int], list[int]]:
        """The ids of words that are one pre-token each, and how many each has."""
        found = list(map(self._tokenizer.model.tokenize, _as_chars(words)))
        return list(map(attrgetter("id"), chain.from_iterable(found))), list(map(len, found))

    def _by_all(self, words: pa.Array) -> tuple[list[int], list[int]]:
        found = [x.ids for x in self._tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return list(chain.from_iterable(found)), list(map(len, found))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, which are known afterwards.

        Of new words plain runs of letters, one pre-token each, go through the model alone, marks after them once each.
        Only those that neither is are Python strings one by one.
        """
        hashes = _hashes_of(words)
        out = self._find(hashes, *_bytes_of(words))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        names = words.take(pa.array(new))
        heads = pa.compute.ascii_rtrim(names, characters=_TAIL)
        plain = pa.compute.match_substring_regex(heads, _PLAIN).to_numpy(zero_copy_only=False)
        whole = (pa.compute.binary_length(heads).to_numpy() == pa.compute.binary_length(names).to_numpy()) & plain
        for which, tokens in ((whole, self._by_model), (~plain, self._by_all)):
            rows = np.flatnonzero(which)
            for i in range(0, len(rows), 4096):
                some = rows[i : i + 4096]
                part = names.take(pa.array(some))
                ids, sizes = tokens(part)
                out[new[some]] = self._add(part, hashes[new[some]], np.array(ids, np.int32), np.array(sizes, np.int64))
        cut = np.flatnonzero(plain & ~whole)
        if len(cut):
            part, heads = names.take(pa.array(cut)), heads.take(pa.array(cut))
            parts = pa.concat_arrays([heads, _tails(part, heads)]).dictionary_encode()
            numbers = self._numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1)
            ids, sizes = self._gather(numbers.T.ravel())
            out[new[cut]] = self._add(part, hashes[new[cut]], ids, sizes.reshape(-1, 2).sum(axis=1))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self._hashes) > self._cached:
            self._clear()
        split = pa.compute.split_pattern(pa.array([_lower(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        ids, sizes = self._gather(self._numbers(words.dictionary)[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(split).to_numpy())])]
        return ids, np.diff(ends)


def _encoder(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = WordEncoder.load(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            for a, b in row_slices(texts, _SLICE):
                ids, sizes = encoder.encode(texts[a:b])
                ids, sizes = np.insert(ids, np.cumsum(sizes), np.int32(end_id)), sizes + 1
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                columns = [pa.array(np.full(b - a, part, np.int32)), whole.column(0).slice(a, b - a), pa.array(before + ends - sizes), pa.array(sizes), tokens]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local_start", "n_tokens", "tokens"])

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes the token ids of each row of docs to ORC files below path, in ascending order of doc_id over all files.

    tokenizer is a file of the tokenizers library whose tokens do not cross white space; end_id ends each document.
    Null texts are empty ones and have the end id alone; null doc_ids come first; rows that share a doc_id follow
    each other, by the hash of their text; an empty table makes files without rows. Each file holds a range of
    documents, in stripes that can be read apart; every index_rows rows have their own minima and Bloom filter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_bytes),
        "orc.row.index.stride": str(index_rows),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.encoding.strategy": "SPEED",
    }
    ordered.mapInArrow(_encoder(tokenizer, end_id), SCHEMA).write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files below path; of the documents given alone, whose stripes minima and Bloom filters find."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        at, data = tokens.offsets.to_numpy(), memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<i4")).tobytes())
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        sizes = pa.array(np.diff(at).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), sizes, pa.array(sums, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def file_starts(rows: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before each; one row a file, from the counts alone."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead: Column = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(ahead, F.lit(0)).alias("before"))


def index_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files below path, from what the files hold.

    start counts the ids of all documents before it, n_tokens those of its own with the end id, ids_crc32 is the
    unsigned CRC-32 of them as little-endian unsigned 32-bit integers.
    """
    rows = read_token_files(spark, path)
    found = rows.select("part", "doc_id", "local_start", "tokens").mapInArrow(_checksums, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    starts = file_starts(rows)
    return found.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
