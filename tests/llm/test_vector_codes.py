"""Vector codes against plain Lloyd rounds, and on odd and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """The contract in plain loops: complete rescans, integers of any size."""
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                if own := [c[p] for c, a in zip(cut, at, strict=True) if a == k]:
                    books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    total = {}
    for (_, _, y), f in zip(kept, found, strict=True):
        total[y] = total.get(y, 0) + sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[y], hashlib.sha256(text.encode()).hexdigest()) for (i, _, y), f in zip(kept, found, strict=True)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1, 0, 1]) / 8 + rnd.gauss(0, 0.02) for _ in range(8)], rnd.choice([None, 0, 1, 1, 1])) for i in range(400)]
    rows += [(900 + i, [0.25] * 8, 1) for i in range(150)] + [(7, rows[7][1], 0), (None, [0.5] * 8, None), (None, [-0.5] * 8, 2)]
    rows += [(500, None, 1), (501, [0.1] * 7 + [None], 1), (502, [float("nan")] + [0.0] * 7, 1), (503, [float("inf")] + [0.0] * 7, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("entries,rounds", [(16, 4), (256, 2), (3, 6)])
def test_codes_equal_plain_rounds(spark, vectors, entries, rounds):
    frame = spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "'clash' AS codes", "'clash' AS errors", "'clash' AS ints", "'clash' AS v", "'clash' AS error")
    rows, books = vector_codes.compress(frame.repartition(5), 4, entries, rounds)
    got = sorted((tuple(r) for r in vector_codes.digest(rows, books).collect()), key=repr)
    assert got == plain(vectors, 4, entries, rounds)


def test_label_sums_beyond_the_broadcast_bound(spark, vectors, monkeypatch):
    rows, books = vector_codes.compress(spark.createDataFrame(vectors, SCHEMA), 4, 8, 1)
    want = sorted(map(tuple, vector_codes.digest(rows, books).collect()), key=repr)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.digest(rows, books).collect()), key=repr) == want


def test_active_entries_spare_distances_and_keep_ties():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-3, 4, (3000, 4))
    before = rnd.integers(-3, 4, (40, 4))
    none = np.full(len(x), -1)
    code, error, taken = vector_codes.assign_active(x, none, none, before, np.arange(40))
    assert taken == 40 * len(x)
    for moved in ([], [0], [5, 39, 12], list(range(40))):
        after = before.copy()
        after[moved] += rnd.integers(-1, 2, (len(moved), 4))
        got = vector_codes.assign_active(x, code, error, after, np.array(moved, int))
        whole = ((x[:, None] - after[None]) ** 2).sum(axis=2)
        assert (got[0] == whole.argmin(axis=1)).all() and (got[1] == whole.min(axis=1)).all()
        stayed = ~np.isin(code, moved)
        assert got[2] == stayed.sum() * len(moved) + (~stayed).sum() * 40


def test_large_components_are_exact_or_an_error():
    x = np.array([[1 << 25, -(1 << 25)], [0, 1]])
    assert vector_codes.distances(x, x[:1] - 1).tolist() == [[2], [((1 << 25) - 1) ** 2 + ((1 << 25) + 2) ** 2]]
    with pytest.raises(ValueError):
        vector_codes.distances(x * 4, x)


def test_decoding_gives_the_entries(spark, vectors):
    rows, books = vector_codes.compress(spark.createDataFrame(vectors, SCHEMA), 4, 64, 3)
    whole = {r.vec_id: r.vector for r in vector_codes.decode(rows, books).collect()}
    near = [np.abs(np.array(whole[i]) - np.array(v)).max() for i, v, _ in vectors if i is not None and i < 400 and i != 7]
    assert np.median(near) < 0.1 and len(whole) == 551


def test_empty_tables_and_other_lengths(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.digest(*vector_codes.compress(none)).count() == 0
    mixed = spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1), (3, [], 1)], SCHEMA)
    assert [r.vec_id for r in vector_codes.digest(*vector_codes.compress(mixed)).collect()] == [1]
    nothing = spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)
    assert {(r.code, r.error) for r in vector_codes.digest(*vector_codes.compress(nothing)).collect()} == {("00000000", 0)}
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 6, 1)], SCHEMA))
