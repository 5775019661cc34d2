"""Reading text files: encodings, statute, amendment, ruling and case folders, uploads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.coerce import route
from lexmill.functions.vocabulary import LAWS

LAW_ENCODINGS = ("utf-8", "utf-16", "cp1256", "windows-1256")
CASE_ENCODINGS = ("utf-8", "cp1256", "latin-1")
MAX_UPLOAD_BYTES = 20 << 20


def decoder(encodings: Sequence[str]):
    """A column function that decodes bytes by the first encoding that fits, at last as UTF-8 with replacements.

    UTF-16 fits only with a byte order mark, as most bytes of even length could be UTF-16 without one.
    """

    def decode_one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in encodings:
            if encoding == "utf-16" and bytes(data[:2]) not in (b"\xff\xfe", b"\xfe\xff"):
                continue
            try:
                return bytes(data).decode(encoding)
            except UnicodeError:
                continue
        return bytes(data).decode("utf-8", errors="replace")

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(decode_one)

    return decode


def read_files(spark: SparkSession, path: str, encodings: Sequence[str] = LAW_ENCODINGS, recursive: bool = False, max_bytes: int | None = None) -> DataFrame:
    """(path, folder, name, stem, length, text) of the files below path that are not blank."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    rows = files.select(
        "path",
        F.element_at(parts, -2).alias("folder"),
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        "length",
        decoder(encodings)("content").alias("text"),
    )
    return rows.filter(F.length(F.trim("text")) > 0)


def law_registry(spark: SparkSession) -> DataFrame:
    """(law_id, folder, law_title, promulgation_date): one row for each law, nine in all."""
    return spark.createDataFrame(LAWS, "law_id string, folder string, law_title string, promulgation_date string")


def law_files(spark: SparkSession, root: str) -> DataFrame:
    """Statute files of known law folders, with law_id, law_title and kind: main, tables or amendment.

    Files whose name starts with "new" are amendments, of others those with "tables" in the name hold tables. A name
    that starts with "new" in other case is neither.
    """
    files = read_files(spark, f"{root}/*/*.txt")
    named = files.join(F.broadcast(law_registry(spark)), "folder")
    kind = F.when(F.col("name").startswith("new"), "amendment").when(F.lower("name").startswith("new"), None)
    return named.withColumn("kind", kind.when(F.lower("name").contains("tables"), "tables").otherwise("main")).filter("kind IS NOT NULL")


def case_law_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the folder are books of principles, those of its sub-folders rulings of a category."""
    books = read_files(spark, f"{root}/*.txt").withColumn("doc_type", F.lit("principle"))
    rulings = read_files(spark, f"{root}/*/*.txt").withColumn("doc_type", F.lit("ruling"))
    return books.unionByName(rulings)


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, doc_id, document_type, text, error) of a case folder's files; what is not readable text is an error row."""
    files = spark.read.format("binaryFile").load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.trim(decoder(CASE_ENCODINGS)("content"))
    error = F.when(~F.lower(name).endswith(".txt"), "not a text file").when(F.length(text) == 0, "empty file").when(route(stem).isNull(), "unknown document type")
    return files.select(F.element_at(parts, -2).alias("case_id"), stem.alias("doc_id"), route(stem).alias("document_type"), text.alias("text"), error.alias("error"))


def validate_uploads(files: DataFrame) -> DataFrame:
    """files (name, length) with reason: why an upload is rejected, or null."""
    reason = F.when(~F.lower("name").endswith(".txt"), "unsupported extension").when(F.coalesce("length", F.lit(0)) == 0, "empty file").when(F.col("length") > MAX_UPLOAD_BYTES, "file too large")
    return files.withColumn("reason", reason)


def joined_folder(files: DataFrame) -> DataFrame:
    """(folder, text): each folder's texts in order of path, parted by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "text")))
    return files.groupBy("folder").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
