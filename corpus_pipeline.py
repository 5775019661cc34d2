"""The corpus pipeline: from documents to token ids, in stages that each call one operator of lexmill.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import line_dedup, mixing, near_dedup, segmentation, toxicity
from lexmill.llm.common import discard, made, staged

#: File of the public tokenizer that the last stage encodes with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Copies of a document that are sampled in one search at most; more are in further searches of their own.
TOGETHER = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. Labels come from the table labels.

    A null or empty text has the score of a text without evidence and stays like others below 0.5; rows of one doc_id are
    judged each by its own text, repeated rows alike; rows without doc_id are judged too. No documents give none; other
    columns are handed on, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject_toxic(docs, labels, threshold=0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that 10 documents or more hold, and those of 50 words or more that two or more
    hold, stay only where they come first.

    A document that loses all of its lines goes; one that was empty before stays, a null text as it is. Repeated rows
    are told apart by doc_id and text; other columns are handed on, whatever their names, as they go by other names inside.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    inside = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns])
    clean = line_dedup.drop_repeated_lines(inside, min_chars=20, min_docs=10, keep_first=True, long_words=50, long_docs=2)
    return clean.filter("n_dropped < n_lines").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id and text hash; of repeated rows one.

    Rows without doc_id stay. Rows that share a doc_id are told apart by the hash of their text; of rows alike in both the
    one whose columns have the smallest hash stays.
    """
    judged = staged(near_dedup.near_duplicates(docs, words=5, percent=80).filter("doc_id IS NOT NULL").select("doc_id", "text_id", "group_id"), "judged")
    row = F.struct("doc_id", "text_id")
    best = judged.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min(row).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = staged(judged.join(best, "group_id").filter(row != F.col("best")).select("doc_id", "text_id").distinct(), "near-duplicates")
    again = staged(judged.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")), "repeated-rows")
    text_id = F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (text_id == gone["text_id"]), "left_anti")
    same = (F.col("doc_id") == F.col("__id")) & (text_id == F.col("__text"))
    row_of = F.struct(*[f"`{c}`" for c in docs.columns])
    one = kept.join(again, same).groupBy("__id", "__text").agg(F.min_by(row_of, F.xxhash64(row_of)).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 5, 2, 1, repeating; each document is taken up to three times.

    A null source is one of its own, the last; null and empty texts have no words, so their number of copies changes
    nothing and is drawn like others'; rows alike in source, doc_id and text share their copies evenly; no documents
    give none; other columns are handed on, whatever their names.
    """
    return mixing.mix(docs, [5.0, 2.0, 1.0], cap=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A segmentation of every row's text, as token ids: the copies of a document have distinct samples, drawn without
    replacement by their probability.

    Rows alike in doc_id and text are counted, TOGETHER at most are sampled in one search, and any partitioning gives
    the same samples, without a doc_id too. A text with fewer segmentations than copies, such as a null or empty one,
    gives them in turn, so that each row has one; other columns are not read.
    """
    alike = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = alike.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))))
    wanted = F.least(F.lit(TOGETHER), F.col("n") - F.col("copy") * TOGETHER)
    return segmentation.encode_samples(parts, PIECES, k=wanted, copy=F.col("copy"), fill=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The mix and the segmentations are random; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written before the next one reads it; what a stage staged on the way
    and its input go once its result is written."""
    docs, inputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = set(made())
        docs = staged(stage(spark, docs, sf_dir), f"after-{name}")
        own = [path for path in made() if path not in before]
        discard(spark, inputs + own[:-1])
        inputs = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
