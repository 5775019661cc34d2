"""The stored vector index: exact hits, recall of the first lists, pruned reads, odd tables."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import search, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(40, 12))
    x = centres[rnd.integers(0, 40, 3000)] + 0.25 * rnd.normal(size=(3000, 12))
    x[:700] = x[0]  # a group of copies
    x[711] = 0
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").cache()


def asked(vectors):
    return vectors.filter("doc_id % 20 = 0 OR doc_id = 711").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@pytest.mark.parametrize("measure", ["cosine", "l2"])
def test_exact_search_equals_brute_force(spark, vectors, tmp_path, monkeypatch, measure):
    monkeypatch.setattr(vector_index, "ROWS", 100)
    monkeypatch.setattr(vector_index, "ASKED", 16)
    vector_index.write_vector_index(vectors, str(tmp_path), measure=measure)
    got = vector_index.search_vector_index(spark, str(tmp_path), asked(vectors), 5, probes=2, digits=9)
    want = search.nearest(vectors, asked(vectors), 5, measure=measure, digits=9)
    key = lambda r: (r.query_id, r.rank, r.doc_id, round(r.score, 8))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_first_lists_have_most_hits_and_are_read_alone(spark, vectors, tmp_path):
    path = str(tmp_path)
    vector_index.write_vector_index(vectors, path)
    own = asked(vectors).filter("query_id >= 700")
    got = vector_index.search_vector_index(spark, path, own, 10, probes=4, exact=False)
    want = search.nearest(vectors, own, 10)
    true = {(r.query_id, r.doc_id) for r in want.collect()}
    recall = len(true & {(r.query_id, r.doc_id) for r in got.collect()}) / len(true)
    assert recall >= 0.9
    (r,) = spark.read.parquet(f"{path}/lists").filter("doc_id = 1000").collect()
    few = own.filter("query_id = 1000")
    before = vector_index.search_vector_index(spark, path, few, 10, probes=1, exact=False).collect()
    for folder in os.listdir(f"{path}/lists"):  # what is not asked need not be there
        if folder.startswith("list=") and folder != f"list={r.list}":
            shutil.rmtree(f"{path}/lists/{folder}")
    assert vector_index.search_vector_index(spark, path, few, 10, probes=1, exact=False).collect() == before and before[0].doc_id == 1000


def test_every_vector_is_stored_once(spark, vectors, tmp_path):
    vector_index.write_vector_index(vectors, str(tmp_path), lists=7)
    stored = spark.read.parquet(f"{tmp_path}/lists")
    assert stored.count() == 3000 and stored.select("list").distinct().count() <= 7
    centres = spark.read.parquet(f"{tmp_path}/centres")
    assert sum(r.n for r in centres.collect()) == 3000


def test_odd_tables(spark, tmp_path):
    kinds = "doc_id long, embedding array<float>"
    empty = spark.createDataFrame([(1, None)], kinds)
    vector_index.write_vector_index(empty, f"{tmp_path}/a")
    ask = spark.createDataFrame([(5, [1.0, 0.0]), (6, None)], "query_id long, query_embedding array<float>")
    assert vector_index.search_vector_index(spark, f"{tmp_path}/a", ask, 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], kinds)
    vector_index.write_vector_index(few, f"{tmp_path}/b")
    got = vector_index.search_vector_index(spark, f"{tmp_path}/b", ask, 9, probes=1).collect()
    assert sorted((r.query_id, r.doc_id, r.score) for r in got) == [(5, 1, 1.0), (5, 1, 1.0), (5, 2, 0.5)]
