"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF vectors over a block-max inverted index, votes, calibration."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranges, row_slices, staged

#: Bound of what is learnt: labelled examples (those of the smallest hash of doc_id), with all their words.
MAX_EXAMPLES = 8000
NEIGHBOURS, BLOCK = 15, 256
#: A block's terms that so many of its examples have are laid out as a matrix; groups of alike examples, and terms that
#: tell them apart.
_DENSE, _GROUPS, _GROUP_TERMS = 12, 24, 512
_WORD = re.compile(r"[^\W\d_]+")
#: Scores are first made in single precision; what may be among the nearest by this much is compared again.
_SLACK = 1e-5
#: Scores that a task keeps by text, characters that it counts and texts that it scores at once.
_CACHE, _SLICE, _QUERIES = 50_000, 1 << 20, 128
#: Terms and weights of a vector, in arrays.
Vector = tuple[np.ndarray, np.ndarray]


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall((text or "").lower())


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept apart from learning: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _arrays(vector: dict[int, float] | Vector) -> Vector:
    if isinstance(vector, dict):
        return np.fromiter(vector.keys(), np.int64, len(vector)), np.fromiter(vector.values(), float, len(vector))
    return vector


def _grouped(pairs: list[Vector], size: int) -> list[int]:
    """An order of vectors that puts alike ones next to each other: by k-means over their commonest terms, then by
    their heaviest ones."""
    lengths = np.array([len(t) for t, _ in pairs])
    term, weight = (np.concatenate([np.zeros(0, kind), *(p[i] for p in pairs)]) for i, kind in ((0, np.int64), (1, float)))
    common = np.argsort(-np.bincount(term, minlength=size), kind="stable")[:_GROUP_TERMS]
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    kept = column[term] >= 0
    x = np.zeros((len(pairs), len(common)))
    x[np.repeat(np.arange(len(pairs)), lengths)[kept], column[term[kept]]] = weight[kept]
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    centres = x[np.random.default_rng(0).permutation(len(x))[:_GROUPS]]
    group = np.zeros(len(x), np.int64)
    for _ in range(8):
        group = np.argmax(x @ centres.T, axis=1) if len(x) else group
        for i in range(len(centres)):
            if (group == i).any():
                total = x[group == i].sum(axis=0)
                centres[i] = total / max(np.sqrt(total @ total), 1e-9)
    heaviest = [t[np.lexsort((t, -w))[:16]].tolist() for t, w in pairs]
    return sorted(range(len(pairs)), key=lambda i: (group[i], heaviest[i]))


class BlockMaxIndex:
    """Unit vectors in blocks, with each term's greatest weight in each block; finds the nearest by exact cosine.

    Each block keeps the terms that many of its examples have as a matrix, the others as postings. A query's rare terms
    are scored by postings everywhere; a block's bound is the greatest such score in it, plus the query times the
    greatest weights of the block's common terms.
    """

    def __init__(self, vectors: list[dict[int, float] | Vector], toxic: np.ndarray, clean: np.ndarray, ids: list[int]):
        pairs = [_arrays(v) for v in vectors]
        self.size = max((int(t.max()) + 1 for t, _ in pairs if len(t)), default=0)
        order = _grouped(pairs, self.size) if pairs else []
        self.toxic, self.clean, self.ids = toxic[order], clean[order], np.array(ids, np.int64)[order]
        self.place = np.argsort(np.array(order, np.int64))
        self.rows = np.concatenate([[0], np.cumsum([len(pairs[i][0]) for i in order])]).astype(np.int64)
        self.row_term = np.concatenate([np.zeros(0, np.int32), *(pairs[i][0] for i in order)]).astype(np.int32)
        self.row_weight = np.concatenate([np.zeros(0), *(pairs[i][1] for i in order)])
        self.matrices: list[tuple[np.ndarray, np.ndarray]] | None = None

    def vector(self, place: int) -> Vector:
        """The vector of the example at a place."""
        here = slice(self.rows[place], self.rows[place + 1])
        return self.row_term[here], self.row_weight[here]

    def _lay_out(self) -> None:
        """The blocks' matrices and the postings, from the vectors in order; workers make them when they first search."""
        many = len(self.ids)
        self.starts = np.arange(0, many, BLOCK)
        at = np.repeat(np.arange(many), np.diff(self.rows))
        common = np.zeros(len(at), bool)
        self.matrices = []  # terms; weights by term and example
        for low in self.starts.tolist():
            here = slice(self.rows[low], self.rows[min(low + BLOCK, many)])
            names, which, held = np.unique(self.row_term[here], return_inverse=True, return_counts=True)
            dense = held >= _DENSE
            common[here] = dense[which]
            place = np.cumsum(dense) - 1
            matrix = np.zeros((int(dense.sum()), min(BLOCK, many - low)), np.float32)
            matrix[place[which[common[here]]], at[here][common[here]] - low] = self.row_weight[here][common[here]]
            self.matrices.append((names[dense], matrix))
        self.dense = np.unique(np.concatenate([np.zeros(0, np.int32), *(n for n, _ in self.matrices)]))
        self.column = np.full(self.size + 1, -1, np.int64)
        self.column[self.dense] = np.arange(len(self.dense))
        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(self.row_term[rare], kind="stable")]
        self.at, self.weight = at[rare], self.row_weight[rare]
        self.terms = np.searchsorted(self.row_term[rare], np.arange(self.size + 1))

    def nearest(self, query: dict[int, float] | Vector) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the NEIGHBOURS nearest examples of positive cosine, and of all that tie with the last."""
        return self.nearest_each([_arrays(query)])[0]

    def nearest_each(self, queries: list[Vector], left_out: list[tuple[int, int]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest for each query; left_out has a position for each of them, of which so many copies do not count.

        Blocks are scored by falling bound, as long as one may hold a nearer example than the last found; what may be
        among the nearest is then compared by its whole vector, so the result does not depend on the other queries.
        """
        if self.matrices is None:
            self._lay_out()
        many, wanted = len(self.ids), NEIGHBOURS + 1
        if not many:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        owner = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        term, weight = (np.concatenate([np.zeros(0, kind), *(q[i] for q in queries)]) for i, kind in ((0, np.int64), (1, float)))
        known = term < self.size
        owner, term, weight = owner[known], term[known].astype(np.int64), weight[known]
        low, sizes = self.terms[term], self.terms[term + 1] - self.terms[term]
        held = ranges(low, sizes)
        rare = np.bincount(np.repeat(owner * many, sizes) + self.at[held], self.weight[held] * np.repeat(weight, sizes), len(queries) * many).reshape(-1, many).astype(np.float32)
        dense = np.zeros((len(queries), len(self.dense)), np.float32)
        column = self.column[term]
        dense[owner[column >= 0], column[column >= 0]] = weight[column >= 0]
        bound = np.maximum.reduceat(rare, self.starts, axis=1)
        for i, (names, matrix) in enumerate(self.matrices):
            if len(names):
                bound[:, i] += dense[:, self.column[names]] @ matrix.max(axis=1)
        score, least, open_blocks = np.full(rare.shape, -np.inf, np.float32), np.zeros(len(queries), np.float32), bound > 0
        for step in (3, len(self.starts)):
            pick = open_blocks & (bound >= least[:, None] - _SLACK)
            if not pick.any():
                break
            if step < len(self.starts):
                value = np.where(pick, bound, -np.inf)
                pick &= value >= -np.partition(-value, step - 1, axis=1)[:, step - 1 : step]
            open_blocks &= ~pick
            for i, (names, matrix) in enumerate(self.matrices):
                rows = np.flatnonzero(pick[:, i])
                if len(rows):
                    here = slice(self.starts[i], self.starts[i] + matrix.shape[1])
                    score[rows, here] = rare[rows, here] + (dense[np.ix_(rows, self.column[names])] @ matrix if len(names) else np.float32(0))
            if many > wanted:
                least = np.maximum(np.partition(score, many - wanted, axis=1)[:, many - wanted], 0.0)
        out, laid_out = [], np.zeros(self.size + 1)
        for i, (terms, weights) in enumerate(queries):
            at = np.flatnonzero((score[i] > 0) & (score[i] >= least[i] - _SLACK))
            laid_out[terms[terms < self.size]] = weights[terms < self.size]
            cosine = self._cosines(at, laid_out)
            laid_out[terms[terms < self.size]] = 0.0
            copies = self.toxic[at] + self.clean[at]
            if left_out is not None:
                copies[at == left_out[i][0]] -= left_out[i][1]
            near = np.lexsort((at, -cosine))
            near = near[(copies[near] > 0) & (cosine[near] > 0)]
            at, cosine = at[near], cosine[near]
            enough = np.searchsorted(np.cumsum(copies[near]), NEIGHBOURS)
            if enough < len(at):
                kept = cosine >= cosine[enough] - 1e-12
                at, cosine = at[kept], cosine[kept]
            out.append((at, cosine))
        return out

    def _cosines(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The cosines of examples with a query that is laid out by term, each by its own vector alone."""
        sizes = self.rows[at + 1] - self.rows[at]
        held = ranges(self.rows[at], sizes)
        return np.add.reduceat(query[self.row_term[held]] * self.row_weight[held], np.cumsum(sizes) - sizes) if len(at) else np.zeros(0)


@dataclass
class Model:
    """What votes need: the terms' weights, the index, the share of toxic examples, of all and of those without terms."""

    weights: np.ndarray
    index: BlockMaxIndex
    prior: float
    blank: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> Vector:
        """The unit vector of term counts."""
        raw = (1 + np.log(counts)) * self.weights[terms]
        return terms, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw

    def votes(self, vectors: list[Vector], left_out: list[tuple[int, int, int]] | None = None) -> list[tuple[float, np.ndarray]]:
        """The distance-weighted share of toxic neighbours of each vector, drawn to the prior, and the neighbours' positions.

        left_out has (position, toxic, clean): copies of an example that do not count for its own vector.
        """
        out = [(self.blank, np.zeros(0, np.int64))] * len(vectors)
        some = [i for i, v in enumerate(vectors) if len(v[0])]
        for j in range(0, len(some), _QUERIES):
            part = some[j : j + _QUERIES]
            skip = None if left_out is None else [(left_out[i][0], left_out[i][1] + left_out[i][2]) for i in part]
            for i, (at, cosine) in zip(part, self.index.nearest_each([vectors[i] for i in part], skip), strict=True):
                toxic, clean = self.index.toxic[at].astype(float), self.index.clean[at].astype(float)
                if left_out is not None:
                    toxic[at == left_out[i][0]] -= left_out[i][1]
                    clean[at == left_out[i][0]] -= left_out[i][2]
                weight = cosine**2
                out[i] = (float((weight @ toxic + 0.5 * self.prior) / (weight @ (toxic + clean) + 0.5)), at)
        return out


def calibrated(vote: float, steps: tuple[np.ndarray, np.ndarray]) -> float:
    """The vote as a calibrated probability; a hundredth of the vote itself keeps the order of votes."""
    return float(0.99 * np.interp(vote, *steps) + 0.01 * vote)


def isotonic(votes: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps nearest to toxic / n by votes, by pooling adjacent violators, as points to interpolate."""
    pools: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        pools.append([votes[i] * n[i], toxic[i], n[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


def _counted(terms):
    """(doc_id, text_id, terms, counts) of each row, of the examples' words alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, kinds = {w: i for i, w in enumerate(terms.value.to_pylist())}.get, pa.int32()
        for whole in batches:
            texts = [t or "" for t in whole.column(2).to_pylist()]
            for a, b in row_slices(texts, _SLICE):
                found = [words(t) for t in texts[a:b]]
                flat = np.fromiter((get(w, -1) for ws in found for w in ws), np.int64)
                row = np.repeat(np.arange(b - a), [len(ws) for ws in found])
                pairs, counts = np.unique((row << 32 | flat)[flat >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) << 32).astype(np.int32))
                columns = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32), kinds)) for x in (pairs & 0xFFFFFFFF, counts)]
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), whole.column(1).slice(a, b - a), *columns], names=["doc_id", "text_id", "terms", "counts"])

    return count


def _frequencies(n: int):
    """(term, rows): in how many rows of a task each term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "rows"])

    return count


def _bags(table) -> Iterator[Vector]:
    """(terms, counts) of each row of a batch or table with these columns."""
    terms, counts = (table.column(name) for name in ("terms", "counts"))
    if isinstance(terms, pa.ChunkedArray):
        terms, counts = terms.combine_chunks(), counts.combine_chunks()
    ends = np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)).tolist()
    terms, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, counts))
    for low, high in zip([0, *ends], ends, strict=False):
        yield terms[low:high], counts[low:high]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(words(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def choose_examples(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): at most MAX_EXAMPLES of the labelled rows that are not held out, by the hash of doc_id.

    A doc_id with several labels counts as toxic if any is; null labels and ids are left out.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return staged(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES), "examples")


def example_words(docs: DataFrame, examples: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """All words of the examples, and 1 + the root of each one's chi-square against the label; examples of one text
    count once. What the labels say about a word thus raises its weight, and no word is left out."""
    rows = _rows(docs).join(F.broadcast(examples), "doc_id").dropDuplicates(["text_id"])  # at most MAX_EXAMPLES rows
    each = rows.select("toxic", "text").mapInArrow(_distinct_words, "toxic int, words array<string>")
    each = staged(each, "example-words")
    total = each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    by_word = each.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    found = by_word.toArrow().sort_by("word")
    a, m = (found.column(x).to_numpy().astype(float) for x in ("t", "n"))
    n, t, b = float(total.n), float(total.t), m - a
    below = m * (n - m) * t * (n - t)
    chi2 = np.divide(n * (a * (n - t - b) - b * (t - a)) ** 2, below, out=np.zeros(len(m)), where=below > 0)
    return found.column("word").combine_chunks(), 1 + np.sqrt(chi2)


def _without_themselves(model):
    """(vote, toxic, n) of examples (place, label, many): the vote of an example's vector without its own."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            places, labels, many = (batch.column(i).to_pylist() for i in range(3))
            votes = m.votes([m.index.vector(p) for p in places], [(p, x, 1 - x) for p, x in zip(places, labels, strict=True)])
            toxic = [x * n for x, n in zip(labels, many, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in votes], pa.float64()), pa.array(toxic, pa.int64()), pa.array(many, pa.int64())], names=["vote", "toxic", "n"])

    return vote


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast[Model], tuple[np.ndarray, np.ndarray], DataFrame]:
    """The model, the calibration and every row's counts of its terms (doc_id, text_id, terms, counts).

    Labels are learnt from the bounded examples alone, whose words are the terms; in how many rows a term is, from all
    rows. The driver holds the examples' vectors; what the votes of each of them would be without it, tasks find out.
    """
    spark = docs.sparkSession
    examples = choose_examples(labels)
    names, telling = example_words(docs, examples)
    terms = spark.sparkContext.broadcast(names)
    counted = staged(_rows(docs).mapInArrow(_counted(terms), "doc_id long, text_id long, terms array<int>, counts array<int>"), "term-counts")
    terms.unpersist()
    n = counted.count()
    df = np.zeros(len(names))
    frequencies = counted.select("terms").mapInArrow(_frequencies(len(names)), "term int, rows long")
    rows = frequencies.groupBy("term").agg(F.sum("rows").alias("rows")).toArrow()
    df[rows.column("term").to_numpy()] = rows.column("rows").to_numpy()
    known = counted.join(F.broadcast(examples), "doc_id").select("doc_id", "toxic", "terms", "counts").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    model = Model((np.log((1 + n) / (1 + df)) + 1) * telling, None, 0.0, 0.0)
    groups: dict[bytes, list] = {}
    toxic = 0
    for doc_id, label, bag in zip(known.column("doc_id").to_pylist(), known.column("toxic").to_pylist(), _bags(known), strict=True):
        group = groups.setdefault(hashlib.sha256(bag[0].tobytes() + bag[1].tobytes()).digest() if len(bag[0]) else b"", [0, 0, doc_id, bag])
        group[1 - label] += 1
        toxic += label
    blank = groups.pop(b"", [0, 0, 0])
    model.prior = (toxic + 0.5) / (known.num_rows + 1)
    model.blank = (blank[0] + 0.5 * model.prior) / (blank[0] + blank[1] + 0.5)
    counts = np.array([[g[0], g[1]] for g in groups.values()], np.int64).reshape(-1, 2)
    model.index = BlockMaxIndex([model.vector(*g[3]) for g in groups.values()], counts[:, 0], counts[:, 1], [g[2] for g in groups.values()])
    sent = spark.sparkContext.broadcast(model)
    apart = [(place, label, many) for pair, place in zip(counts.tolist(), model.index.place.tolist(), strict=True) for label, many in ((1, pair[0]), (0, pair[1])) if many]
    table = pa.table({x: pa.array([a[i] for a in apart], pa.int64()) for i, x in enumerate(("place", "label", "many"))})
    left_out = spark.createDataFrame(table).repartition(spark.sparkContext.defaultParallelism).mapInArrow(_without_themselves(sent), "vote double, toxic long, n long").toArrow().sort_by([("vote", "ascending"), ("toxic", "ascending"), ("n", "ascending")])
    votes, hits, many = (left_out.column(x).to_numpy().astype(float) for x in ("vote", "toxic", "n"))
    if sum(blank[:2]):
        votes, hits, many = np.append(votes, model.blank), np.append(hits, blank[0]), np.append(many, blank[0] + blank[1])
    return sent, isotonic(votes, hits, many), counted


def _scored(model, steps: tuple[np.ndarray, np.ndarray]):
    """(doc_id, text_id, score, evidence) of rows of term counts; equal texts are scored once."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = model.value, {}
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                if len(seen) > _CACHE:
                    seen.clear()
                text_ids = batch.column(1).to_pylist()
                new = {t: bag for t, bag in zip(text_ids, _bags(batch), strict=True) if t not in seen}
                votes = m.votes([m.vector(*bag) for bag in new.values()])
                seen.update((t, (calibrated(vote, steps), m.index.ids[at[:3]].tolist())) for t, (vote, at) in zip(new, votes, strict=True))
                columns = [batch.column(0), batch.column(1), pa.array([seen[t][0] for t in text_ids], pa.float64()), pa.array([seen[t][1] for t in text_ids], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "score", "evidence"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_id, score, evidence) of each row of docs; text_id is the xxhash64 of the text.

    score, 0 to 1, is the calibrated vote of the NEIGHBOURS nearest examples, weighted by the squared cosine; evidence
    has up to three of them, nearest first. The cosine is that of TF-IDF vectors of all words that any example has, a
    word's weight raised by 1 + the root of its chi-square against the label; words that no example has can't bring an
    example nearer and aren't part of the norm. It depends on the text and the model alone, so equal texts have equal
    scores. Texts without any such word, null and empty ones among them, take the share of toxic examples without any.
    With no labels at all every score is that of the prior. An empty table gives an empty result; other columns of docs
    are not read.
    """
    model, steps, counted = fit(docs, labels)
    return counted.mapInArrow(_scored(model, steps), "doc_id long, text_id long, score double, evidence array<long>")


def digest(scored: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each row."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns; rows are told apart by doc_id and text."""
    scored = score_documents(docs, labels).filter(F.col("score") >= threshold)
    bad = staged(scored.select(F.col("doc_id").alias("__doc_id"), F.col("text_id").alias("__text_id")).distinct(), "toxic-texts")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__text_id"))
    return docs.join(bad, same, "left_anti")
