"""What the corpus operators share: the shared folder, written stages and numpy hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Multipliers of the splitmix64 finalizer (fixed values).
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary one if driver and executors are one machine (local mode), else the warehouse.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="lexmill-shared-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexmill-shared"
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders that this driver made below the shared folder and has not discarded.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/lexmill/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def staged(df: DataFrame, label: str, **options: object) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders that are there to be discarded, oldest first."""
    return list(_made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that staged or new_path made, once nothing that reads them is needed any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a column of this name: 0, 1, ... among rows of equal keys, which are numbered within their parts first.

    Which of the rows with equal keys has which number is left open; a key that very many rows share is spread over tasks.
    """
    cut = staged(rows.withColumn("__part", F.spark_partition_id()), "to-number")
    counts = cut.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__here"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__before", F.coalesce(F.sum("__here").over(ahead), F.lit(0))).filter("__before > 0").drop("__here")
    firsts = firsts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before")
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.lit(0))) - 1
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = cut.withColumn("__local", local).join(firsts, same, "left")
    return joined.select(*rows.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def rows_each(df: DataFrame, rows: int) -> int:
    """How many buckets give about so many rows each: a power of two, from an exact count."""
    return 1 << max(0, (max(1, df.count()) - 1) // rows).bit_length()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each uint64."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """n uint64 that depend on the seed alone."""
    return mix(mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)))


#: A value for each byte, and the base of running hashes and its inverse modulo 2 ** 64.
_BYTE = random_table(256, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that a task works on at once, but for a longer text.
SLICE_BYTES = 1 << 20
#: Which bytes are ASCII white space, and each byte with A-Z as a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(1 << 12, _BASE), _powers(1 << 12, _INVERSE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The 64-bit hash of each span of a UTF-8 buffer, which depends on its bytes alone; A-Z count as a-z if lower."""
    global _up, _down
    if len(data) >= len(_up):
        n = 1 << int(len(data)).bit_length()
        _up, _down = _powers(n, _BASE), _powers(n, _INVERSE)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data] if lower else data] * _up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * _down[starts] + (ends - starts).astype(np.uint64))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first, bytes, offsets) of runs of texts of about SLICE_BYTES; null texts are empty."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Flat:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self._data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self._data):
            self._data = np.append(self._data, np.zeros_like(self._data))
        self._data[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self._data[: self.size]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def row_slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each."""
    at, room = 0, chars
    for i, text in enumerate(texts):
        room -= len(text)
        if room <= 0 or i == len(texts) - 1:
            yield at, i + 1
            at, room = i + 1, chars
