"""A stored index of vectors: lists around centres, read only where a query's nearest can be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import new_folder

from .search import top

#: Lists at most, vectors that centres are fitted on at most, vectors and queries that one task compares at once.
MOST_LISTS, SAMPLE, ROWS, ASKED = 4096, 50_000, 4096, 2048
#: Lists that every query reads first.
PROBES = 8
#: What rounding may hide.
_SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.stack(rows).astype(np.float64)


def _placed(x: np.ndarray, measure: str) -> np.ndarray:
    """Vectors where lists are made: at length 1 for cosine, so that distance follows the angle; as they are for l2."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if measure == "cosine" else x


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0))


def _centres(rows: DataFrame, key: str, lists: int, measure: str) -> np.ndarray:
    """Centres of k-means on the SAMPLE vectors whose keys hash lowest."""
    few = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding")
    if measure == "cosine":
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        few = few.select(F.transform("embedding", lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("embedding"))
    model = KMeans(k=lists, seed=1, maxIter=12, featuresCol="v").fit(few.select(array_to_vector("embedding").alias("v")))
    return np.array(model.clusterCenters())


def write_vector_index(vectors: DataFrame, path: str, key: str = "doc_id", measure: str = "cosine", lists: int | None = None) -> None:
    """Stores vectors (key, embedding) below path: lists/list=<n>/ has the vectors nearest to centre n, centres a row for
    each list with its centre, size and radius.

    There are as many lists as the root of the number of vectors, MOST_LISTS at most, or as given. Rows without a vector
    are left out; keys may repeat; vectors must be of one length. No vectors make an index without lists.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    number = min(lists or max(1, round(n**0.5)), MOST_LISTS)
    centres = _centres(rows, key, number, measure) if n else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _apart(_placed(_matrix(batch.column(1)), measure), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.min(axis=1)), pa.array(far.argmin(axis=1).astype(np.int32))], names=[key, "embedding", "apart", "list"])

    placed = rows.mapInArrow(assign, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<double>, apart double, list int")
    # a list that very many vectors share is written by several tasks
    spark.sql("SELECT /*+ REBALANCE(list) */ * FROM {placed}", placed=placed).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    sizes = placed.limit(0) if not n else spark.read.parquet(f"{path}/lists")
    sizes = sizes.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    sizes.join(F.broadcast(known), "list").withColumn("measure", F.lit(measure)).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")  # MOST_LISTS rows at most


def _probes(table: pa.Table, probes: int, beyond: bool):
    """(query_id, query_embedding, list) of the nearest lists; beyond: of all others that may hold something nearer than
    the query's column reach."""
    centres, radius, numbers = _matrix(table["centre"]), table["radius"].to_numpy(), table["list"].to_numpy()
    measure = table["measure"][0].as_py()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ASKED):
                part = batch.slice(i, ASKED)
                far = _apart(_placed(_matrix(part.column(1)), measure), centres)
                order = np.argsort(far, axis=1, kind="stable")
                if beyond:
                    near = far - radius <= part.column(2).to_numpy(zero_copy_only=False)[:, None] + _SLACK
                    near[np.arange(len(far))[:, None], order[:, :probes]] = False
                    row, at = np.nonzero(near)
                else:
                    at = order[:, :probes].ravel()
                    row = np.repeat(np.arange(len(far)), min(probes, len(centres)))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(numbers[at].astype(np.int32))], names=["query_id", "query_embedding", "list"])

    return choose


def _comparer(k: int, measure: str):
    """The best k of a block of vectors for each query of a block, and what ties with the last of them."""

    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return pa.table({"query_id": queries["query_id"].slice(0, 0), "key": vectors["key"].slice(0, 0), "score": pa.array([], pa.float64())})
        x, q = _matrix(vectors["embedding"]), _matrix(queries["query_embedding"])
        if measure == "cosine":
            size = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
            score = (1 + np.divide(q @ x.T, size, out=np.zeros(size.shape), where=size > 0)) / 2
        else:
            score = -((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * q @ x.T)
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(q), -np.inf)
        row, at = np.nonzero(score >= least[:, None] - _SLACK)
        found = score[row, at] * (1 if measure == "cosine" else -1)
        return pa.table({"query_id": queries["query_id"].take(pa.array(row)), "key": vectors["key"].take(pa.array(at)), "score": pa.array(found)})

    return compare


def _compared(spark: SparkSession, path: str, asked: DataFrame, sizes: dict[int, int], k: int, key: str, measure: str) -> DataFrame:
    """(query_id, key, score) of the best of each asked list (query_id, query_embedding, list); only those lists are read.

    A list's vectors and its queries meet in blocks, so neither a long list nor one that very many queries ask is one task's.
    """
    wanted = {r.list: r.n for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS at most
    blocks = spark.createDataFrame([(i, -(-sizes[i] // ROWS), -(-n // ASKED)) for i, n in wanted.items()], "list int, vs long, qs long")

    def spread(frame: DataFrame, own: str, by: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        placed = frame.join(F.broadcast(blocks), "list").withColumn(own, F.pmod(F.xxhash64(by), F.col(f"{own}s")))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))

    rows = spark.read.parquet(f"{path}/lists").filter(F.col("list").isin(*wanted)) if wanted else spark.read.parquet(f"{path}/lists").limit(0)
    vectors = spread(rows.select(F.col(key).alias("key"), "embedding", "list"), "v", "key", "q").select("key", "embedding", "list", "v", "q")
    queries = spread(asked, "q", "query_id", "v").select("query_id", "query_embedding", "list", "v", "q")
    kinds = f"query_id {dict(asked.dtypes)['query_id']}, key {dict(vectors.dtypes)['key']}, score double"
    return vectors.groupBy("list", "v", "q").cogroup(queries.groupBy("list", "v", "q")).applyInArrow(_comparer(k, measure), kinds)


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "doc_id", probes: int = PROBES, exact: bool = True, digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k nearest stored vectors of each query (query_id, query_embedding); query_ids are
    distinct.

    Scores are those of search.nearest: (1 + cosine) / 2, greatest first, or squared distances, least first, rounded to
    digits before they are ranked if given; equal scores rank by key. Every query compares itself with the vectors of its
    nearest lists. If exact, it then reads each further list that can hold a vector nearer than its k-th so far, by the
    distance to the centre less the radius, so nothing is missed; else those lists are not read, and some hits may be.
    """
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()
    asked = queries.filter("query_embedding IS NOT NULL").select("query_id", F.col("query_embedding").cast("array<double>").alias("query_embedding"))
    if not len(centres):
        return asked.select("query_id", F.lit(None).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    measure = centres["measure"][0].as_py()
    sizes = dict(zip(centres["list"].to_pylist(), centres["n"].to_pylist(), strict=True))
    kinds = f"query_id {dict(asked.dtypes)['query_id']}, query_embedding array<double>, list int"
    ascending = measure != "cosine"
    first = _compared(spark, path, asked.mapInArrow(_probes(centres, probes, False), kinds), sizes, k, key, measure)
    if exact:
        folder = new_folder(spark, "vector-hits")
        first.write.parquet(folder)
        first = spark.read.parquet(folder)
        last = top(first, k, "key", ascending=ascending).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.max("score") if ascending else F.min("score")).alias("worst"))
        reach = F.sqrt(F.greatest(F.col("worst"), F.lit(0.0))) if ascending else F.sqrt(F.greatest(4 - 4 * F.col("worst"), F.lit(0.0)))
        reach = F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(reach)
        reached = asked.join(last, "query_id", "left").select("query_id", "query_embedding", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
        later = new_folder(spark, "vector-probes")
        reached.mapInArrow(_probes(centres, probes, True), kinds).write.parquet(later)
        first = first.unionByName(_compared(spark, path, spark.read.parquet(later), sizes, k, key, measure))
    found = first.select("query_id", F.col("key").alias(key), "score" if digits is None else F.round("score", digits).alias("score"))
    return top(found, k, key, ascending=ascending)
