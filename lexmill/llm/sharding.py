"""Sharding: rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_each


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard 0..len(weights)-1 with the highest score -weight / ln(u), u a uniform hash of (key, shard).

    Key, weights and seed decide alone. A shard that is added takes keys only into itself, and about its share of the
    weights; a removed one gives up only its own. A null key is a key like any other; a weight of 0 takes nothing.
    """
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights must not be negative")
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(seed), F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        score = -F.lit(float(weight)) / F.log(u) if weight else F.lit(-1.0)
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("tie")))
    if not scores:
        raise ValueError("at least one shard is needed")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["tie"]).cast("int")


def slots(rows: DataFrame, group: str, key: str, order: Sequence[str], bucket_rows: int = 100_000) -> DataFrame:
    """rows with slot: their number 0, 1, ... within group, without gaps, and without sorting a group in one task.

    Hash buckets of the key and the order cut each group into pieces of about bucket_rows / groups rows; a piece's
    first slot is the count of the pieces before it.
    """
    spare = [f"__{name}_{len(rows.columns)}" for name in ("bucket", "before", "here")]
    bucket, before, here = spare
    n = rows_each(rows.select(group), bucket_rows)
    cut = rows.withColumn(bucket, F.pmod(F.xxhash64(key, *order, F.lit("slot")), F.lit(n)))
    counts = cut.groupBy(group, bucket).agg(F.count(F.lit(1)).alias(here))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(group, bucket, F.coalesce(F.sum(here).over(ahead), F.lit(0)).alias(before))
    within = Window.partitionBy(group, bucket).orderBy(*order)
    return (
        cut.join(firsts, [group, bucket])
        .withColumn("slot", F.col(before) + F.row_number().over(within) - 1)
        .select(*rows.columns, "slot")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    The law is "key": doc_id and the shards decide. size is the text's UTF-8 bytes plus 1 (a null text has none),
    text_crc32 the CRC-32 of the text (a null one: of no bytes). slot numbers each shard's rows by hash bucket, then
    doc_id; grown_shard is the shard once one more, of weight grown, is there. Repeated rows share a shard and have
    slots of their own; a null doc_id is a key of its own; an empty table gives an empty result; other columns of
    docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights, seed).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, grown], seed).alias("grown_shard"),
    )
    numbered = slots(placed, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
