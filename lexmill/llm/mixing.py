"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, staged

#: A document of more than 1/LARGE of its source's size is rounded first; a source has fewer than LARGE of them.
LARGE = 256
#: Documents, and later residuals, that meet in one group of the tree.
GROUP = 64


def word_count(text: Column) -> Column:
    """Number of words parted by ASCII white space; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, documents, target) from rows (source, size).

    The sources, by code point and null last, have the weights in turn, again and again. They share the total of all
    sizes by weight; no target exceeds cap times its source's size, and what is over is shared again by weight until
    none does (all of it is placed if cap is 1 or more). Equals min(level * weight, cap * size) for the level at which
    the targets sum to the total: the greatest of those that arise when the first k sources by cap / weight are full.
    """
    totals = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")), "sources")
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("rank", turn).withColumn("weight", F.get(weigh, F.pmod("rank", F.lit(len(weights)))))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.greatest(F.lit(0.0), F.least(F.col("level") * F.col("weight"), F.col("most")))
    return staged(levelled.select("source", "source_size", "documents", target.alias("target")), "targets")


def _pair(w: float, p: float, v: float, q: float, u: float) -> tuple[float, float]:
    """The probabilities of two units of sizes w and v after mass has moved between them until one is integral.

    Mass goes to the first by as much as it can take and the second can give, or the other way, with the chances that
    keep both expectations; w * p + v * q does not change.
    """
    gain, loss = min(w * (1 - p), v * q), min(w * p, v * (1 - q))
    moved = gain if u * (gain + loss) < loss else -loss
    p, q = p + moved / w, q - moved / v
    whole = lambda x: 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
    return whole(p), whole(q)


def pivot(weights: np.ndarray, p: np.ndarray, random: np.random.Generator, tail: float = 0.0, tail_p: float = 0.0) -> tuple[np.ndarray, float]:
    """The probabilities after pairing two units at a time, in the order given: what is left fractional of a pair meets
    the next unit, and what is left of all meets the tail, a bundle of further units with one probability.

    All units but at most one end at 0 or 1, and none but the tail is left fractional if the tail can take or give as
    much as the last one needs. Every expectation and the total of weight * probability are kept.
    """
    w, p, u = weights.astype(float).tolist(), p.astype(float).tolist(), random.random(len(weights) + 1).tolist()
    at = None
    for i in range(len(w)):
        if 0 < p[i] < 1:
            if at is None:
                at = i
                continue
            p[at], p[i] = _pair(w[at], p[at], w[i], p[i], u[i])
            at = at if 0 < p[at] < 1 else i if 0 < p[i] < 1 else None
    if at is not None and tail > 0 and 0 < tail_p < 1:
        p[at], tail_p = _pair(w[at], p[at], tail, tail_p, u[-1])
    return np.array(p), tail_p


def _rounder(level: str, seed: int) -> Callable[[pa.Table], pa.Table]:
    def rounded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__size", "descending"), ("doc_id", "ascending"), ("__text_id", "ascending"), ("__number", "ascending")])
        name = repr((seed, level, rows["source"][0].as_py(), rows["__bucket"][0].as_py()))
        random = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode())))
        p = rows["__p"].to_numpy()
        tail = float(rows["__tail"][0].as_py())
        p, tail_p = pivot(rows["__size"].to_numpy(), p, random, tail, float(p[0]) if tail else 0.0)
        if rows["__buckets"][0].as_py() == 1 and not tail:
            p = np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, random.random(len(p)) < p))
        return rows.set_column(rows.schema.get_field_index("__p"), "__p", pa.array(p)).append_column("__tail_p", pa.array(np.full(len(p), tail_p)))

    return rounded


def copies(docs: DataFrame, weights: Sequence[float], cap: float = 3.0, seed: int = 0, size: Column | None = None, text_id: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, copies: how often the mix takes each row, so that sources near their targets.

    size is the number of words, or the column given, text_id what tells rows of one doc_id apart, the hash of the
    text or the column given; see source_targets for target. Each row's expected copies are target / source_size;
    the whole part is taken surely, the fraction by pivotal rounding that keeps both each row's expectation and,
    but for the rounding of one small document, the source's total of words. Rows of no words are taken surely
    floor(target / source_size) times. The random choices depend on seed, source, doc_id and text_id alone, so reruns
    and other partitionings agree; rows alike in all of them and size are interchangeable. Null texts have size 0; a
    null source is a source; a null doc_id is one id. An empty table gives an empty result. Columns of docs named like
    a new one are replaced, all others stay; give few columns, as all of them are moved through the tree.

    A source's fewer than LARGE large documents are paired first, two at a time, and what is left with the bundle of
    its small ones, whose common probability takes up the rest; then the small ones in groups of GROUP, two at a time,
    the one residual of each group in groups of GROUP again, and so on up to one group for each source.
    """
    new = ["size", "source_size", "target", "copies"]
    counted = word_count(F.col("text").cast("string")) if size is None else size
    told = F.xxhash64(F.col("text").cast("string")) if text_id is None else text_id
    rows = docs.withColumn("__size", counted).withColumn("__text_id", told).drop(*new)
    done = _rounded(numbered(rows, ["source", "doc_id", "__text_id", "__size"], "__number"), weights, cap, seed)
    keep = [F.col(x) for x in docs.columns if x not in new]
    return done.select(*keep, F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def _rounded(rows: DataFrame, weights: Sequence[float], cap: float, seed: int) -> DataFrame:
    """rows (source, doc_id, __text_id, __number, __size, ...) with __source_size, __target and __copies."""
    targets = source_targets(rows.select("source", F.col("__size").alias("size")), weights, cap)
    table = targets.select(F.col("source").alias("__name"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("documents").alias("__documents"))
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("__name")), "left").drop("__name")
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("__rate", rate).withColumn("__whole", F.floor("__rate")).withColumn("__p", F.col("__rate") - F.col("__whole"))
    large = F.col("__size") * LARGE > F.col("__source_size")
    buckets = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("__documents") / GROUP, F.lit(1.0))))).cast("long")
    rows = rows.withColumn("__buckets", buckets).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "__text_id", "__number", F.lit(seed)), F.col("__buckets")))
    rows = staged(rows.withColumn("__large", large).withColumn("__tail", F.lit(0.0)).drop("__rate", "__documents"), "to-mix")

    sure = rows.filter("__size = 0 OR __p = 0").withColumn("__p", F.lit(0.0))
    open_rows = rows.filter("__size > 0 AND __p > 0")
    small_sizes = staged(open_rows.groupBy("source").agg(F.sum(F.when(~F.col("__large"), F.col("__size")).otherwise(0)).cast("double").alias("__rest")), "small-sizes")
    big = open_rows.filter("__large").drop("__tail").alias("r").join(small_sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    big = big.select("r.*", F.col("__rest").alias("__tail")).withColumn("__bucket", F.lit(0).cast("long")).withColumn("__buckets", F.lit(1).cast("long"))
    fields = [f"`{name}` {kind}" for name, kind in big.dtypes]
    schema = ", ".join([*fields, "__tail_p double"])
    done_big = staged(big.groupBy("source").applyInArrow(_rounder("large", seed), schema), "rounded")
    left_p = staged(done_big.groupBy("source").agg(F.max("__tail_p").alias("__left_p")), "small-probabilities")
    small = open_rows.filter("NOT __large").alias("r").join(left_p.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left")
    small = small.select("r.*", "__left_p").withColumn("__p", F.coalesce("__left_p", "__p")).drop("__left_p").select(*big.columns)

    finished = [sure.select(*big.columns), done_big.drop("__tail_p")]
    most = rows.agg(F.max("__buckets")).first()[0] or 1
    level = 0
    while True:
        out = staged(small.groupBy("source", "__bucket").applyInArrow(_rounder(str(level), seed), schema), "rounded").drop("__tail_p")
        whole = (F.col("__p") <= 0) | (F.col("__p") >= 1)
        finished.append(out.filter(whole))
        if most == 1:
            break
        small = out.filter(~whole).withColumn("__bucket", F.floor(F.col("__bucket") / GROUP)).withColumn("__buckets", F.greatest(F.lit(1).cast("long"), F.floor(F.col("__buckets") / GROUP)))
        most, level = max(1, most // GROUP), level + 1
    everything = finished[0]
    for part in finished[1:]:
        everything = everything.unionByName(part)
    return everything.withColumn("__copies", (F.col("__whole") + F.when(F.col("__p") >= 1, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float], cap: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with all their columns; see copies.

    The choice is made on sizes and hashes alone, and joined to the texts afterwards by source, doc_id and the hash of
    the text; rows alike in all three are numbered.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("source"), F.col("doc_id"), F.xxhash64(text).alias("text_id"), word_count(text).alias("words"))
    taken = copies(slim, weights, cap, seed, F.col("words"), F.col("text_id"))
    each = staged(taken.groupBy("source", "doc_id", "text_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").cast("int").alias("copies")), "copies")
    each = each.select(*[F.col(x).alias(f"__{x}") for x in each.columns])
    same = lambda rows: F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (rows == F.col("__text_id"))
    single = docs.join(each.filter("__rows = 1 AND __copies > 0"), same(F.xxhash64(text)))
    out = single.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
    alike = each.filter("__rows > 1 AND __copies > 0")
    if alike.limit(1).count():
        # so many rows share so many copies: each has its part of them, as even as can be
        held = numbered(docs.join(alike, same(F.xxhash64(text))), ["__source", "__doc_id", "__text_id"], "__n")
        part = F.floor((F.col("__n") + 1) * F.col("__copies") / F.col("__rows")) - F.floor(F.col("__n") * F.col("__copies") / F.col("__rows"))
        more = held.withColumn("__copies", part.cast("int")).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        out = out.unionByName(more.select(*docs.columns))
    return out
