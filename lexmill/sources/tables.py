"""Tables in and out: nodes, edges, indexes, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str) -> None:
    """One Parquet folder for each label, the edges by relation; what was there is replaced."""
    for label, frame in nodes.items():
        frame.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, labels: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    return {label: spark.read.parquet(f"{path}/nodes/{label}") for label in labels}, spark.read.parquet(f"{path}/edges")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_index(chunks: DataFrame, path: str) -> None:
    """A vector index: chunks with embeddings. An empty one is an error."""
    if chunks.isEmpty():
        raise ValueError("there is nothing to index")
    chunks.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_embeddings(nodes: DataFrame, embedded: DataFrame, key: str = "id") -> DataFrame:
    """nodes with the embedding of embedded (key, embedding), or else the one that they had."""
    had = F.col("n.embedding") if "embedding" in nodes.columns else F.lit(None)
    others = [F.col(f"n.`{c}`") for c in nodes.columns if c != "embedding"]
    return nodes.alias("n").join(embedded.alias("e"), F.col(f"n.{key}") == F.col(f"e.{key}"), "left").select(*others, F.coalesce("e.embedding", had).alias("embedding"))


def to_json_rows(frame: DataFrame) -> DataFrame:
    """One column json; null fields are left out."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("json"))


def export_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
