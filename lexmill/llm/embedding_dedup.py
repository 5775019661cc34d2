"""Embedding near-duplicates by product quantisation: coarse lists, residual codes, asymmetric distances, exact rerank."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_each, staged
from .components import connected_components

#: Vectors that the quantisers are fitted on, at most: those of the smallest hash of vec_id.
MAX_FITTED = 20_000
#: Coarse cells at least and at most, and rows of the largest label for each between; subspaces and codes of each.
MIN_CELLS, MAX_CELLS, CELL_ROWS, SUBSPACES, CODES = 16, 1024, 2048, 16, 256
#: Rows of a list that meet in one block, and queries that are compared with it at once.
BLOCK, QUERIES = 4096, 128
#: Slack for rounding in distances before the exact rerank.
SLACK = 1e-4


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centres, and for each subspace of the residuals its code words."""

    centres: np.ndarray
    words: np.ndarray  # subspace, code, dimension

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 0) -> Quantiser:
        random = np.random.default_rng(seed)
        centres = _kmeans(x, cells, random)
        parts = cls._split(x - centres[cls._nearest(x, centres)])
        return cls(centres, np.stack([_kmeans(p, CODES, random) for p in parts]))

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """x as (subspace, row, dimension), with zeros up to a multiple of SUBSPACES."""
        wide = -(-x.shape[1] // SUBSPACES) * SUBSPACES
        padded = np.zeros((len(x), wide))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), SUBSPACES, -1).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error) of each row; error is its distance from what cell and codes stand for."""
        cell = self._nearest(x, self.centres)
        parts = self._split(x - self.centres[cell])
        codes = np.stack([self._nearest(p, w) for p, w in zip(parts, self.words, strict=True)], axis=1)
        error = sum(((p - w[codes[:, i]]) ** 2).sum(axis=1) for i, (p, w) in enumerate(zip(parts, self.words, strict=True)))
        return cell, codes.astype(np.uint8), np.sqrt(error)

    @cached_property
    def apart(self) -> np.ndarray:
        """The distances of the centres from each other."""
        square = (self.centres**2).sum(axis=1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * self.centres @ self.centres.T, 0))

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """(row, cell): which cells may hold a vector within reach of each row.

        A vector in cell c is on c's side of the border between c and any other centre, so the row is at most reach
        beyond each of these borders; those with the row's nearest centres are looked at.
        """
        square = (x**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        near = np.argsort(square, axis=1)[:, :8]
        out = np.ones(square.shape, bool)
        for j in range(near.shape[1]):
            other = near[:, j]
            beyond = square - np.take_along_axis(square, other[:, None], axis=1)
            out &= beyond <= 2 * (reach + SLACK) * self.apart[other] + 1e-9
        return out

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """(row, subspace, code): squared distances of each row's residual in the cell from all code words."""
        parts = self._split(x - self.centres[cell])
        return np.stack([(p**2).sum(axis=1)[:, None] + (w**2).sum(axis=1) - 2 * p @ w.T for p, w in zip(parts, self.words, strict=True)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


_CODED = "label long, id long, many long, cell int, codes binary, error double, embedding array<double>"
_ENTRY = "label long, cell int, block int, query boolean, id long, many long, codes binary, error double, embedding array<double>"


def _coder(quantiser):
    """Each class with its cell, codes and coding error."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cell, codes, error = q.encode(_unit(_matrix(batch.column("embedding"))))
                columns = [*(batch.column(x) for x in ("label", "id", "many")), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CODED.split(", ")])

    return code


def _placed(quantiser, split, reach: float):
    """Each class once as an entry of its own block, and as a query in every later block that it probes.

    Blocks are ordered by cell and number, so that of two blocks the members of one are queries in the other and
    never the other way round.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, blocks_of = quantiser.value, split.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                probes = q.probes(_unit(_matrix(batch.column("embedding"))), reach)
                row, cells, blocks, query = [], [], [], []
                for i, (label, own, key) in enumerate(zip(batch.column("label").to_pylist(), batch.column("cell").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                    mine = zlib.crc32(key.to_bytes(8, "little", signed=True)) % blocks_of.get((label, own), 1)
                    probes[i, own] = True
                    for c in np.flatnonzero(probes[i, own:]).tolist():
                        first = mine if c == 0 else 0
                        many = blocks_of.get((label, own + c), 1)
                        row += [i] * (many - first)
                        cells += [own + c] * (many - first)
                        blocks += range(first, many)
                        query += [c > 0 or b > mine for b in range(first, many)]
                take = pa.array(row, pa.int64())
                columns = [batch.column("label").take(take), pa.array(cells, pa.int32()), pa.array(blocks, pa.int32()), pa.array(query, pa.bool_()), *(batch.column(x).take(take) for x in ("id", "many", "codes", "error", "embedding"))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ENTRY.split(", ")])

    return place


@dataclass
class _Rows:
    """Rows of a block in arrays."""

    ids: np.ndarray
    many: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, parts: list[pa.RecordBatch]) -> _Rows:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        return cls(batch.column("id").to_numpy(), batch.column("many").to_numpy(), _matrix(batch.column("embedding")), codes, batch.column("error").to_numpy())

    def part(self, a: int, b: int) -> _Rows:
        return _Rows(self.ids[a:b], self.many[a:b], self.x[a:b], self.codes[a:b], self.error[a:b])


def _search(quantiser, cosine: float, reach: float):
    """Streams each block's entries, then its queries, and yields (id, links, root): with how many vectors of the block
    each row is linked, and a member of the block's linked group that the row and its links share. A pair of rows meets
    in one block alone, and counts for both."""

    def compare(held: _Rows, asked: _Rows, cell: int, first: int | None, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of asked and held; asked rows from the place first of held itself meet the later ones alone."""
        tables = q.tables(_unit(asked.x), cell)
        near = np.zeros((len(asked.ids), len(held.ids)))
        for s in range(SUBSPACES):
            near += tables[:, s, held.codes[:, s]]
        may = np.sqrt(np.maximum(near, 0)) <= reach + held.error + SLACK
        if first is not None:
            may &= np.arange(len(held.ids)) > first + np.arange(len(asked.ids))[:, None]
        a, b = np.nonzero(may)
        norm = np.sqrt((asked.x * asked.x).sum(axis=1))[a] * np.sqrt((held.x * held.x).sum(axis=1))[b]
        linked = (np.einsum("ij,ij->i", asked.x[a], held.x[b]) / norm >= cosine) & (asked.ids[a] != held.ids[b])
        return a[linked], b[linked]

    def answer(held: _Rows, asked: _Rows, cell: int, first: int | None, q: Quantiser) -> pa.RecordBatch:
        a, b = compare(held, asked, cell, first, q)
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(asked.ids[a].tolist(), held.ids[b].tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        ids = [asked.ids, held.ids, np.array(list(root), np.int64)]
        links = [np.bincount(a, weights=held.many[b], minlength=len(asked.ids)), np.bincount(b, weights=asked.many[a], minlength=len(held.ids)), np.zeros(len(root))]
        some = [links[0] > 0, links[1] > 0, np.ones(len(root), bool)]
        roots = [ids[0], ids[1], np.array([find(i) for i in root], np.int64)]
        columns = [np.concatenate([x[k] for x, k in zip(v, some, strict=True)]).astype(np.int64) for v in (ids, links, roots)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "root"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, at, parts, held = quantiser.value, None, [], None

        def within() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and parts:
                held = _Rows.of(parts)
                parts.clear()
                for k in range(0, len(held.ids), QUERIES):
                    yield answer(held, held.part(k, k + QUERIES), at[1], k, q)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at != tuple(keys[i][:3].tolist()):
                    yield from within()
                    at, parts, held = tuple(keys[i][:3].tolist()), [], None
                part = batch.slice(i, j - i)
                if not keys[i][3]:
                    parts.append(part)
                    continue
                yield from within()
                if held is not None:
                    asked = _Rows.of([part])
                    for k in range(0, len(asked.ids), QUERIES):
                        yield answer(held, asked.part(k, k + QUERIES), at[1], None, q)
        yield from within()

    return search


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Rows are linked when their labels are equal and not null and the cosine of their vectors, in double precision, is
    at least cosine. n_links counts the other rows linked directly, component_id is the smallest vec_id reachable by
    links, kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components are
    linked with nothing, as are rows without a label or vec_id; they are kept. Vectors of different lengths are not
    linked. Rows that repeat a vec_id with another vector share one node. An empty table gives an empty result; other
    columns are not read.

    Equal vectors of a label are one class with a count. The quantisers are fitted on at most MAX_FITTED vectors, every
    class is indexed. A class probes every list that can hold a vector as near as cosine asks, and passes over an entry
    only if its distance from the entry's codes exceeds that reach by more than the entry's own coding error: by the
    triangle inequality no link is lost. A list of more than BLOCK rows, counted, is split, so blocks bound what meets in
    a task; two blocks meet once, and links within a block leave it as counts and as a forest, never as all pairs.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), x).alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = staged(rows.withColumn("key", F.xxhash64("embedding", "label")), "vectors")
    whole = rows.filter("embedding IS NOT NULL")
    classes = staged(whole.groupBy("label", "key", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many")), "vector-classes")
    links, component = None, None
    for (wide,) in sorted(classes.select(F.size("embedding")).distinct().toLocalIterator()):
        same = classes.filter(F.size("embedding") == wide)
        sample = same.orderBy(F.xxhash64("id"), "id").limit(MAX_FITTED).select("embedding").toPandas()
        fitted = _unit(np.stack(sample["embedding"].to_numpy()))
        largest = same.groupBy("label").count().agg(F.max("count")).first()[0]
        quantiser = spark.sparkContext.broadcast(Quantiser.fit(fitted, min(len(fitted), MAX_CELLS, max(MIN_CELLS, largest // CELL_ROWS))))
        coded = staged(same.select("label", "id", "many", "embedding").mapInArrow(_coder(quantiser), _CODED), "vector-codes")
        lists = coded.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)  # at most a row for BLOCK vectors
        split = spark.sparkContext.broadcast({(r.label, r.cell): -(-r.n // BLOCK) for r in lists.toLocalIterator()})
        spread = coded.repartition(rows_each(coded, 512)).mapInArrow(_placed(quantiser, split, reach), _ENTRY)
        ordered = spread.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "query")
        found = staged(ordered.mapInArrow(_search(quantiser, cosine, reach), "id long, links long, root long"), "vector-links")
        links = found if links is None else links.unionByName(found)
    many = classes.select("label", "key", "embedding", "id", "many")
    if links is not None:
        counts = staged(links.groupBy("id").agg(F.sum("links").alias("links")), "vector-counts")
        component = connected_components(links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        many = many.join(counts, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    else:
        many = many.withColumn("links", F.lit(0)).withColumn("component", F.col("id"))
    many = staged(many.select("label", "key", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"), "embedding"), "class-components")
    placed = rows.alias("r").join(many.alias("m"), (F.col("r.label") == F.col("m.label")) & (F.col("r.key") == F.col("m.key")) & (F.col("r.embedding") == F.col("m.embedding")), "left")
    home = F.coalesce("m.component_id", "r.vec_id")
    return placed.select("r.vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), home.alias("component_id"), F.coalesce(F.col("r.vec_id") == home, F.lit(True)).alias("kept"))
