"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the lattice of pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Flat, mix, ranges, row_slices

SPACE = "▁"
#: Added to ranks: Mandelbrot's constant of word frequencies.
_OFFSET = 2.7
#: Characters that are sampled at once, but for a longer text, and edges that a task keeps.
_SLICE, _CACHED = 1 << 19, 1_500_000
#: Places, beyond any text, of the random numbers that are no step's.
_FIRST, _BRANCH, _AGAIN = 1 << 40, 1 << 41, 1 << 42

_WORD = re.compile("\n| *[^ \n]+| +")

_loaded: dict[tuple[str, float], Pieces] = {}


class Pieces:
    """The pieces of a model as a trie, each with a weight: (rank + _OFFSET) ** -sharpness.

    The rank is that of the model's own score, so early merges weigh most; pieces without one, and the bytes that
    spell a character without a piece together, have the last rank. At sharpness 1 the weight is the frequency that
    the law of Zipf and Mandelbrot gives a piece of that rank. Pieces have a space for U+2581.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        if not sharpness > 0:
            raise ValueError("sharpness must be above 0")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.byte_weight = -sharpness * np.log(n + _OFFSET)
        spelling, own = [b""] * n, {}
        for i in range(n):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in piece.lstrip(SPACE):
                rank = -score if -n <= score <= 0 else n
                spelling[i] = piece.replace(SPACE, " ").encode()
                own[piece.replace(SPACE, " ")] = (-sharpness * np.log(rank + _OFFSET), i)
        self.spelling = pa.array(spelling, pa.large_binary())
        names = sorted({piece[:end] for piece in own for end in range(1, len(piece) + 1)})
        node = {name: i + 1 for i, name in enumerate(names)} | {"": 0}
        steps = sorted((node[x[:-1]] << 21 | ord(x[-1]), node[x]) for x in names)
        self.steps, self.nodes = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))
        self.weight = np.array([-np.inf, *(own.get(x, (-np.inf,))[0] for x in names)])
        self.id = np.array([0, *(own.get(x, (0, 0))[1] for x in names)], np.int64)
        self.is_piece = np.isfinite(self.weight)
        self.single = np.zeros(0x110000, np.int32)  # each character's node below the root
        self.single[[ord(x) for x in names if len(x) == 1]] = [node[x] for x in names if len(x) == 1]

    @classmethod
    def load(cls, path: str, sharpness: float = 1.0) -> Pieces:
        """The pieces, read once in each worker."""
        if (path, sharpness) not in _loaded:
            _loaded[path, sharpness] = cls(path, sharpness)
        return _loaded[path, sharpness]

    def edges(self, points: np.ndarray, until: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, size, weight, id) of every piece in code points, by rising size; a piece from i ends by until[i].

        A character without a piece of its own is one spelled by its bytes, whose id is -1 - the code point.
        """
        at, size = self.single[points].astype(np.int64), 1
        rows = np.flatnonzero(at)
        at, found = at[rows], []
        while len(rows):
            is_piece = self.is_piece[at]
            ends = at[is_piece]
            found.append((rows[is_piece], np.full(len(ends), size), self.weight[ends], self.id[ends]))
            further = rows + size < until[rows]
            rows, at = rows[further], at[further]
            key = at << 21 | points[rows + size]
            step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = self.steps[step] == key
            rows, at, size = rows[hit], self.nodes[step[hit]], size + 1
        spelled = np.ones(len(points), bool)
        if found:
            spelled[found[0][0]] = False
        rest = np.flatnonzero(spelled)
        found.insert(0, (rest, np.ones(len(rest), np.int64), np.full(len(rest), self.byte_weight), -1 - points[rest]))
        return found

    def ids_of(self, marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that edges' ids stand for, with those of bytes in the place of spelled characters, and their counts."""
        spelled = np.flatnonzero(marks < 0)
        if not len(spelled):
            return marks.astype(np.int32), counts
        points, which = np.unique(-1 - marks[spelled], return_inverse=True)
        data = [chr(p).encode("utf-8", "surrogatepass") for p in points.tolist()]
        wide = np.ones(len(marks), np.int64)
        wide[spelled] = np.array([len(x) for x in data])[which]
        out, first = np.repeat(marks, wide), np.cumsum(wide) - wide
        table = np.array([list(x.ljust(4, b"\0")) for x in data])
        for i in range(4):
            here = spelled[wide[spelled] > i]
            out[first[here] + i] = self.byte_ids[table[which[wide[spelled] > i], i]]
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(counts)])]
        return out.astype(np.int32), np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: the pieces' spellings, bytes joined to characters, without the dummy space."""
        spelled = self.spelling.take(pa.array(ids))
        at = np.frombuffer(spelled.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(counts)])]
        data = memoryview(spelled.buffers()[2] or b"")
        return [bytes(data[a + 1 : b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def blocks_of(text: str) -> list[str]:
    """The blocks of a text after the dummy space: a word with the spaces before it, of any length, or a newline.

    No piece crosses the ends of blocks, so the lattice of a text is the chain of those of its blocks.
    """
    return _WORD.findall(" " + text) if text else []


class _Numbers(dict):
    """Numbers new keys in turn."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each key and place."""
    with np.errstate(over="ignore"):
        return ((mix(keys + mix(places.astype(np.uint64))) >> np.uint64(11)) + 0.5) * 2.0**-53


def _gumbel(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these locations, given that they are at most bound."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(place), -np.inf, np.minimum(bound, place - np.logaddexp(place - bound, np.log(-np.log(u)))))


def row_keys(doc_ids: pa.Array, copies: pa.Array, seed: int) -> np.ndarray:
    """The random key of each row, from doc_id (null is an id of its own), copy and seed alone."""
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    number = copies.to_numpy(zero_copy_only=False).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(mix(ids) + null + np.uint64(seed & 0xFFFFFFFF) * np.uint64(2)) + number)


@dataclass
class _Path:
    """A sample: its edges, log probability and perturbed log probability, and the log probability before each edge."""

    edges: np.ndarray
    blocks: np.ndarray
    before: np.ndarray
    log_prob: float
    perturbed: float


@dataclass
class _Search:
    """The search of one text: its samples, the sets not followed yet (value, path, step, edges taken) and the greatest left out."""

    paths: list[_Path] = field(default_factory=list)
    queue: list[tuple[float, int, int, frozenset[int]]] = field(default_factory=list)


class Lattices:
    """The lattices of blocks, kept in flat arrays, and the samples of texts made of them.

    A block of n characters has nodes 0 to n. Each node's edges are its pieces; an edge's probability is the share of
    its weight times the weight of all ways from its end, so that following edges from node to node draws a
    segmentation by its weight. Weights are summed as logarithms: neither length nor sharpness has a bound.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.base, self.size, self.first = Flat(np.int64), Flat(np.int64), Flat(np.int64)
        self.log_p, self.below, self.rest = Flat(np.float64), Flat(np.float64), Flat(np.float64)
        self.node, self.to, self.mark = Flat(np.int32), Flat(np.int32), Flat(np.int32)
        self.first.add(np.zeros(1, np.int64))

    def learn(self, blocks: Sequence[str]) -> np.ndarray:
        """The numbers of blocks, whose lattices are there afterwards."""
        if self.log_p.size > _CACHED:
            self._clear()
        known = len(self.numbers)
        out = np.fromiter(map(self.numbers.__getitem__, blocks), np.int64, len(blocks))
        if len(self.numbers) > known:
            names = list(self.numbers)
            self._learn(names[known:])
        return out

    def _learn(self, blocks: list[str]) -> None:
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        points = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        until = np.repeat(np.cumsum(size), size)
        found = self.pieces.edges(points, until)
        to_node = np.arange(len(points)) + np.repeat(np.arange(len(blocks)), size)  # each block has one node more
        many = np.zeros(len(points) + len(blocks), np.int64)
        for start, _, _, _ in found:
            many[to_node[start]] += 1
        first = np.cumsum(many) - many
        node, to, mark = (np.empty(int(many.sum()), np.int64) for _ in range(3))
        weight, filled = np.empty(len(node)), first.copy()
        for start, wide, own, ids in reversed(found):  # a node's longest pieces first, as they tend to weigh most
            source = to_node[start]
            at = filled[source]
            node[at], to[at], mark[at], weight[at] = source, source + wide, ids, own
            filled[source] = at + 1
        total = np.zeros(len(many))
        left = until - np.arange(len(points))  # characters from each place to its block's end
        order = to_node[np.argsort(left, kind="stable")]
        bounds = np.cumsum(np.bincount(left)).tolist()
        edges = ranges(first[order], many[order])
        ends = np.cumsum(many[order])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            low, high = int(ends[a] - many[order[a]]), int(ends[b - 1])
            here = edges[low:high]
            total[order[a:b]] = np.logaddexp.reduceat(weight[here] + total[to[here]], ends[a:b] - many[order[a:b]] - low)
        log_p = weight + total[to] - total[node]
        p = np.exp(log_p)
        below, after = np.zeros(len(p)), np.zeros(len(p))  # what the edges before and after one in its node sum to
        some = np.flatnonzero(many)
        for r in range(1, int(many.max())):
            some = some[many[some] > r]
            here = first[some] + r
            below[here] = below[here - 1] + p[here - 1]
            here = first[some] + many[some] - 1 - r
            after[here] = after[here + 1] + p[here + 1]
        with np.errstate(divide="ignore"):
            rest = np.log(below + after)
        below += p
        some = np.flatnonzero(many)
        below[first[some] + many[some] - 1] = np.inf
        n_nodes, n_edges = self.first.size - 1, self.log_p.size
        self.base.add(n_nodes + np.cumsum(size + 1) - size - 1)
        self.size.add(size)
        self.first.add(n_edges + first + many)
        self.log_p.add(log_p)
        self.below.add(below)  # an edge is taken by a number below this
        self.rest.add(rest)
        self.node.add(n_nodes + node)
        self.to.add(np.where(many[to] == 0, -1, n_nodes + to))
        self.mark.add(mark)

    def edges_of(self, node: int) -> np.ndarray:
        """The edges of a node, by falling size."""
        first = self.first.all
        return np.arange(first[node], first[node + 1])

    def _walk(self, node: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows drawn edges from each node to its block's end: all edges, by walker and step, and each one's walker.

        places are the characters of the nodes in their texts.
        """
        first, below, to = self.first.all, self.below.all, self.to.all
        walker, begun, parts = np.arange(len(node)), node, []
        while len(walker):
            u = _uniform(keys, places + (node - begun))
            edge = first[node]
            late = np.flatnonzero(u >= below[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= below[edge[late]]]
            parts.append((walker, edge))
            node = to[edge].astype(np.int64)
            go = node >= 0
            walker, node, keys, places, begun = walker[go], node[go], keys[go], places[go], begun[go]
        walkers = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in parts)])
        step = np.concatenate([np.zeros(0, np.int64), *(np.full(len(w), i) for i, (w, _) in enumerate(parts))])
        many = np.bincount(walkers, minlength=len(begun) if not parts else len(parts[0][0]))
        at = (np.cumsum(many) - many)[walkers] + step
        edges = np.empty(len(at), np.int64)
        edges[at] = np.concatenate([np.zeros(0, np.int64), *(e for _, e in parts)])
        return edges, np.repeat(np.arange(len(many)), many)

    def sample(self, texts: Sequence[str], keys: np.ndarray, k: int) -> list[list[tuple[_Path, float]]]:
        """Of each text at most k distinct segmentations, drawn without replacement by their probability, with their
        inclusion scores.

        Best-first search: the perturbed log probability of a set of segmentations with a common start is a Gumbel
        variable around the log of their total probability, and that of a set's best member equals the set's. The
        best set is taken off the queue and followed to its best member, which is the next sample; the sets that
        branch off at each of its nodes get variables that are at most as large. The inclusion score is the
        probability to be among the samples at the threshold that the first set left out gives, 1 if nothing is left
        out. A text without blocks has the empty segmentation alone.
        """
        cut = [blocks_of(t) for t in texts]
        many = np.array([len(c) for c in cut], np.int64)
        blocks = self.learn([b for c in cut for b in c])
        last = np.cumsum(many)
        start = last - many
        size = self.size.all[blocks]
        place = np.cumsum(size) - size
        text_of = np.repeat(np.arange(len(texts)), many)
        place -= place[np.minimum(start, max(0, len(place) - 1))][text_of] if len(place) else 0
        edges, block = self._walk(self.base.all[blocks], keys[text_of], place)
        log_p = self.log_p.all
        searches = [_Search() for _ in texts]
        best = -np.log(-np.log(_uniform(keys, np.full(len(keys), _FIRST))))
        bounds = np.searchsorted(block, np.append(start, last[-1:]))
        for i, search in enumerate(searches):
            own = edges[bounds[i] : bounds[i + 1]]
            if not len(own):
                search.paths.append(_Path(own, own, np.zeros(0), 0.0, float(best[i])))
                continue
            before = np.cumsum(log_p[own])
            search.paths.append(_Path(own, block[bounds[i] : bounds[i + 1]], np.append(0.0, before[:-1]), float(before[-1]), float(best[i])))
        self._branch(searches, range(len(texts)), [0] * len(texts), keys, blocks, place, k)
        base, node, to = self.base.all, self.node.all, self.to.all
        for j in range(1, k):
            picked = []
            for i, search in enumerate(searches):
                if len(search.paths) == j and search.queue:
                    search.queue.sort(key=lambda s: s[0])
                    value, number, step, taken = search.queue.pop()
                    path = search.paths[number]
                    at, b = int(node[path.edges[step]]), int(path.blocks[step])
                    here = int(place[b] + at - base[blocks[b]])
                    others = np.array([e for e in self.edges_of(at).tolist() if e not in taken])
                    u = _uniform(keys[i : i + 1], np.array([_AGAIN * j + here]))
                    p = np.cumsum(np.exp(log_p[others] - log_p[others].max()))
                    edge = int(others[min(int(np.searchsorted(p, u[0] * p[-1], side="right")), len(others) - 1)])
                    if len(others) > 1:
                        left = np.logaddexp.reduce(log_p[others[others != edge]])
                        again = _gumbel(np.array([path.before[step] + left]), np.array([value]), _uniform(keys[i : i + 1], np.array([_AGAIN * j + _BRANCH + here])))
                        search.queue.append((float(again[0]), number, step, taken | {edge}))
                    picked.append((i, value, path, step, edge, b, here + int(to[edge]) - at))
            if not picked:
                break
            inside = np.array([to[p[4]] >= 0 for p in picked])
            rows = np.array([p[0] for p in picked])
            own_block, sizes = np.array([p[5] for p in picked]), np.array([last[p[0]] - p[5] - 1 for p in picked])
            later = ranges(own_block + 1, sizes)
            walkers = np.concatenate([own_block[inside], later])  # by block, so that a text's follow each other
            nodes = np.concatenate([to[[p[4] for p in picked]].astype(np.int64)[inside], base[blocks[later]]])
            places = np.concatenate([np.array([p[6] for p in picked])[inside], place[later]])
            with np.errstate(over="ignore"):
                fresh = mix(keys + np.uint64(j))
            key = np.concatenate([fresh[rows[inside]], np.repeat(fresh[rows], sizes)])
            turn = np.argsort(walkers, kind="stable")
            edges, walker = self._walk(nodes[turn], key[turn], places[turn])
            block = walkers[turn][walker]
            bounds = np.searchsorted(block, np.append(start[rows], last[rows[-1:]]))
            ends = np.searchsorted(block, last[rows])
            for (i, value, path, step, edge, b, _), a, z in zip(picked, bounds[:-1].tolist(), ends.tolist(), strict=True):
                own = np.concatenate([path.edges[:step], [edge], edges[a:z]])
                before = np.cumsum(log_p[own])
                searches[i].paths.append(_Path(own, np.concatenate([path.blocks[:step], [b], block[a:z]]), np.append(0.0, before[:-1]), float(before[-1]), value))
            self._branch(searches, [p[0] for p in picked], [p[3] + 1 for p in picked], keys, blocks, place, k)
        out = []
        for search in searches:
            threshold = max((s[0] for s in search.queue), default=-np.inf)
            scores = [1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(p.log_prob - threshold, 50.0)))) for p in search.paths]
            out.append(list(zip(search.paths, scores, strict=True)))
        return out

    def _branch(self, searches: list[_Search], rows: Sequence[int], steps: Sequence[int], keys: np.ndarray, blocks: np.ndarray, place: np.ndarray, k: int) -> None:
        """Queues what branches off the newest path of these rows from these steps on; only the best k can ever be taken or left out first."""
        parts = [(i, s, searches[i].paths[-1]) for i, s in zip(rows, steps, strict=True)]
        parts = [(i, s, p) for i, s, p in parts if s < len(p.edges)]
        if not parts:
            return
        sizes = np.array([len(p.edges) - s for _, s, p in parts])
        edges, block = (np.concatenate([getattr(p, x)[s:] for _, s, p in parts]) for x in ("edges", "blocks"))
        at = place[block] + self.node.all[edges] - self.base.all[blocks[block]]
        number = np.array([len(searches[i].paths) - 1 for i, _, _ in parts])
        u = _uniform(np.repeat(keys[[i for i, _, _ in parts]], sizes), at + _BRANCH + np.repeat(number, sizes) * _AGAIN)
        bound = np.repeat([p.perturbed for _, _, p in parts], sizes)
        values = _gumbel(np.concatenate([p.before[s:] for _, s, p in parts]) + self.rest.all[edges], bound, u)
        ends = np.cumsum(sizes).tolist()
        if k == 1:
            most = np.maximum.reduceat(values, [0, *ends[:-1]]).tolist()
            for (i, _, _), value in zip(parts, most, strict=True):
                if value > -np.inf:
                    searches[i].queue.append((value, 0, 0, frozenset()))
            return
        for (i, s, p), n, a, z in zip(parts, number.tolist(), [0, *ends[:-1]], ends, strict=True):
            here = values[a:z]
            few = np.argpartition(-here, k)[: k + 1] if len(here) > k + 1 else np.arange(len(here))
            for t in few.tolist():
                if here[t] > -np.inf:
                    searches[i].queue.append((float(here[t]), n, s + t, frozenset([int(p.edges[s + t])])))


_ROW = "doc_id long, sample int, ids binary, log_prob double, inclusion double, round_trip boolean"
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.bool_()]


def _encoded(doc_ids: pa.Array, texts: list[str], keys: np.ndarray, lattices: Lattices, k: int, fill: bool) -> pa.RecordBatch:
    pieces = lattices.pieces
    found = lattices.sample(texts, keys, k)
    if fill:
        found = [[own[j % len(own)] for j in range(k)] for own in found]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    number = [j for f in found for j in range(len(f))]
    paths = [x for f in found for x in f]
    marks = lattices.mark.all[np.concatenate([np.zeros(0, np.int64), *(p.edges for p, _ in paths)])].astype(np.int64)
    ids, counts = pieces.ids_of(marks, np.array([len(p.edges) for p, _ in paths], np.int64))
    ends = np.cumsum(counts).tolist()
    data = ids.astype("<u4").tobytes()
    wanted = [t.encode() for t in texts]
    decoded = pieces.decode(ids, counts)
    columns = [
        doc_ids.take(pa.array(row)),
        pa.array(number, pa.int32()),
        pa.array([data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()),
        pa.array([p.log_prob for p, _ in paths], pa.float64()),
        pa.array([s for _, s in paths], pa.float64()),
        pa.array([d == wanted[r] for d, r in zip(decoded, row.tolist(), strict=True)], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])


def _encoder(path: str, sharpness: float, seed: int, fill: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(Pieces.load(path, sharpness))  # dropped with the task
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            keys, wanted = row_keys(doc_ids, batch.column(2), seed), batch.column(3).to_numpy()
            for a, b in row_slices(texts, _SLICE):
                for k in np.unique(wanted[a:b]).tolist():
                    own = a + np.flatnonzero(wanted[a:b] == k)
                    yield _encoded(doc_ids.take(pa.array(own)), [texts[i] for i in own.tolist()], keys[own], lattices, k, fill)

    return encode


def encode_samples(docs: DataFrame, model: str, k: int | Column = 2, sharpness: float = 1.0, seed: int = 0, copy: Column | None = None, fill: bool = False) -> DataFrame:
    """(doc_id, sample, ids, log_prob, inclusion, round_trip): up to k distinct segmentations of each row's text; k may
    differ from row to row, and is 1 at least. With fill a text with fewer segmentations gives them in turn, k in all.

    ids are little-endian unsigned 32-bit integers; decoding them gives the text back, as round_trip says. The random
    choices are seeded by seed, doc_id and copy (0 if not given), so a row has the same samples in any run and
    partitioning. Null texts are empty ones, which have one empty segmentation; rows that share doc_id and copy share
    the seed; an empty table gives an empty result; other columns of docs are not read. A task holds one text at a
    time, or short ones together, with its lattice: about 150 bytes for each character of a run without spaces.
    """
    number = F.lit(0) if copy is None else copy
    wanted = k if isinstance(k, Column) else F.lit(k)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.cast("long").alias("copy"), wanted.cast("int").alias("k"))
    return rows.mapInArrow(_encoder(model, sharpness, seed, fill), _ROW)


def digest(samples: DataFrame) -> DataFrame:
    """(doc_id, sample, n_ids, ids_crc32, log_prob, inclusion, round_trip) of each sample."""
    return samples.select("doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "log_prob", "inclusion", "round_trip")
