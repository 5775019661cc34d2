"""Stored tables with a key: upserts that rewrite what they touch, versions that readers hold on to, checks on write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: what an upsert touches is rewritten by the bucket.
BUCKETS = 64


class KeyedTable:
    """A table whose rows have distinct keys, below a path of any file system that Spark writes.

    Rows lie in buckets by a hash of their key, data/<write>/bucket=<n>/. versions/<number> names the folder of each
    bucket that is current; a write adds the next version last of all, so a reader that began before goes on
    with its own version and one that begins later sees the whole write. Nothing is changed in place; prune deletes what
    only older versions name. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # the manifest is small: a name for each bucket
    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, oldest first."""
        system, folder = self._files()
        return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()) if system.exists(folder) else []

    def _manifest(self, version: int) -> dict:
        (text,) = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()
        return json.loads(text)

    def _publish(self, buckets: dict[str, str], schema: str) -> int:
        """Writes the next version under another name and renames it, which either happens or doesn't."""
        system, folder = self._files()
        number = (self.versions() or [0])[-1] + 1
        made = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        out = system.create(made)
        out.write(bytearray(json.dumps({"buckets": buckets, "schema": schema}).encode()))
        out.close()
        if not system.rename(made, self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))):
            raise RuntimeError(f"version {number} was written by another writer")
        return number

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def _checked(self, rows: DataFrame) -> DataFrame:
        """rows, or an error if a key is null or repeated."""
        bad = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(self.key).isNull()).limit(5).collect()
        if bad:
            raise ValueError(f"keys are null or repeated: {[r[0] for r in bad]}")
        return rows

    def _write(self, rows: DataFrame, buckets: dict[str, str], schema: str) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket())
        self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {placed}", placed=placed).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {str(r[0]): folder for r in self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()}
        return self._publish(buckets | made, schema)

    def create(self, rows: DataFrame) -> int:
        """The first version, or a whole new one that replaces all rows; returns its number."""
        return self._write(self._checked(rows), {}, _ddl(rows))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given; only folders that it names are read."""
        known = self._manifest(self.versions()[-1] if version is None else version)
        return self._read(known, known["buckets"])

    def _read(self, known: dict, buckets: dict[str, str]) -> DataFrame:
        out = self.spark.createDataFrame([], known["schema"])
        for folder in sorted(set(buckets.values())):
            own = [int(b) for b, f in buckets.items() if f == folder]
            rows = self.spark.read.schema(f"{known['schema']}, bucket int").parquet(f"{self.path}/{folder}")
            out = out.unionByName(rows.filter(F.col("bucket").isin(*own)).drop("bucket"))
        return out

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows and replaces those of the same keys; the same again changes nothing. Only buckets that have keys of
        rows are read and rewritten. Columns must be those of the table; returns the version's number."""
        self._checked(rows)
        known = self._manifest(self.versions()[-1])
        if _ddl(rows) != known["schema"]:
            raise ValueError(f"columns are {_ddl(rows)}, the table has {known['schema']}")
        touched = {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}
        old = self._read(known, {b: f for b, f in known["buckets"].items() if b in touched})
        merged = old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows)
        return self._write(merged, {b: f for b, f in known["buckets"].items() if b not in touched}, known["schema"])

    def prune(self, keep: int = 2) -> None:
        """Deletes all versions but the last few, and folders that none of those name. No reader may be on older ones."""
        system, folder = self._files()
        numbers = self.versions()
        live = {f for n in numbers[-keep:] for f in self._manifest(n)["buckets"].values()}
        for number in numbers[:-keep]:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number)), False)
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for f in system.listStatus(data):
            if f"data/{f.getPath().getName()}" not in live:
                system.delete(f.getPath(), True)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in sorted(rows.dtypes))
