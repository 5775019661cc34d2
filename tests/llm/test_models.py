"""The operators that learn, search or sample, against brute force, and on odd and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import embedding_dedup, segmentation, toxicity
from lexmill.llm.components import connected_components

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rnd.randint(600, 640), rnd.randint(600, 640)) for _ in range(25)] + [(1, 1), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Embeddings ------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, least):
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x, l) in enumerate(good):
        for j, y, m in good[n + 1 :]:
            if l == m and len(x) == len(y) and float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in root}


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for c in range(40):
        base = rnd.normal(size=16)
        for _ in range(rnd.integers(1, 12)):
            x = (base + rnd.normal(size=16) * rnd.choice([0.0, 0.05, 0.15, 0.3])).astype(np.float32)
            rows.append((len(rows) * 13 % 997, [float(v) for v in x], None if c == 3 else int(c % 3)))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] + [1.0] * 15, 1), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = embedding_dedup.near_vectors(frame, 0.98).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_in_small_blocks_equal_brute_force(spark, monkeypatch):
    """One list larger than a block, probed across its own blocks and from other cells."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 5)
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(6, 24))
    x = np.concatenate([base[rnd.integers(0, 6, 150)] + 0.12 * rnd.normal(size=(150, 24)), rnd.normal(size=(60, 24))])
    label = [1 if i % 4 else 2 for i in range(len(x))]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int"), 0.98).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(len(x), dtype=bool)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(linked.sum(axis=1).tolist())) and linked.sum() > 200
    least = np.arange(len(x))
    for _ in range(50):
        least = np.minimum(least, np.where(linked, least[None, :], len(x)).min(axis=1))
    assert {r.vec_id: r.component_id for r in got} == dict(enumerate(least.tolist()))


def test_vectors_of_nothing(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    got = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, None, None), (2, [1.0], None)], kinds)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in got) == [("1", 0, True), ("2", 0, True), ("None", 0, True)]


# Toxicity --------------------------------------------------------------------------------------------------------------


def test_nearest_examples_equal_brute_force():
    rnd = random.Random(8)
    unit = lambda d: {t: x / math.sqrt(sum(v * v for v in d.values())) for t, x in d.items()}
    vectors = [unit({rnd.randrange(30): rnd.random() + 0.1 for _ in range(rnd.randint(1, 4))}) for _ in range(400)]
    copies = np.array([rnd.randint(1, 3) for _ in vectors])
    index = toxicity.BlockMaxIndex(vectors, copies, np.zeros(len(copies), np.int64), list(range(len(vectors))))
    for _ in range(60):
        q = unit({rnd.randrange(32): rnd.random() + 0.1 for _ in range(3)})
        cosine = {i: sum(w * v.get(t, 0.0) for t, w in q.items()) for i, v in enumerate(vectors)}
        order = sorted((i for i in cosine if cosine[i] > 0), key=lambda i: -cosine[i])
        have, want = 0, []
        for i in order:
            if have >= toxicity.NEIGHBOURS and cosine[i] < cosine[want[-1]] - 1e-12:
                break
            want.append(i)
            have += copies[i]
        at, found = index.nearest(q)
        assert sorted(index.ids[at].tolist()) == sorted(want)
        assert np.allclose(sorted(found), sorted(cosine[i] for i in want))


def corpus(n=400):
    rnd = random.Random(2)
    bad = ["trash", "moron", "scum"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rnd.randint(0, 300)}" for _ in range(30)] + ([rnd.choice(bad).upper() + "!" for _ in range(3)] if toxic else [])
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def plain_toxicity(docs, labels):
    """Scores by plain loops: word weights, cosines with every example, votes, calibration by the minimax formula."""
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in docs}
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    names = sorted({w for i in known for w in words[i]})
    n, t = len(known), sum(known.values())
    weight = {}
    for w in names:
        hold = [i for i in known if w in words[i]]
        m, a = len(hold), sum(known[i] for i in hold)
        below = m * (n - m) * t * (n - t)
        chi2 = n * (a * (n - t - (m - a)) - (m - a) * (t - a)) ** 2 / below if below else 0.0
        weight[w] = (math.log((1 + len(docs)) / (1 + sum(w in x for x in words.values()))) + 1) * (1 + math.sqrt(chi2))

    def vector(i):
        raw = {w: (1 + math.log(c)) * weight[w] for w, c in Counter(words[i]).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = {i: vector(i) for i in words}
    prior = (t + 0.5) / (n + 1)

    def vote(i, without=None):
        near = sorted(((sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()), y) for j, y in known.items() if j != without), reverse=True)
        near = [x for x in near if x[0] > 0]
        if len(near) > 15:
            near = [x for x in near if x[0] >= near[14][0] - 1e-12]
        return (sum(c * c * y for c, y in near) + 0.5 * prior) / (sum(c * c for c, _ in near) + 0.5)

    left_out = sorted((vote(i, i), y) for i, y in known.items())
    y = [x[1] for x in left_out]
    mean = lambda a, b: sum(y[a : b + 1]) / (b - a + 1)
    fitted = [max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    steps, at = [], 0
    for i in range(1, len(y) + 1):
        if i == len(y) or fitted[i] > fitted[at] + 1e-12:
            steps.append((sum(v for v, _ in left_out[at:i]) / (i - at), (sum(y[at:i]) + 0.05) / (i - at + 0.1)))
            at = i
    return {i: 0.99 * np.interp(vote(i), *zip(*steps, strict=True)) + 0.01 * vote(i) for i in words}


def test_scores_equal_plain_loops(spark):
    docs, labels = corpus(130)
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = plain_toxicity([(i, t) for i, t in docs], labels)
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.digest(toxicity.score_documents(frame, known)).collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out)
    assert right / sum(r.held_out for r in got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.reject_toxic(frame, known).count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.score_documents(frame, k).collect()} for k in (known, turned))
    assert one == two


def test_every_word_of_an_example_counts(spark):
    """Words that tell nothing about the label, and rare ones, still lead to the nearest examples."""
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    docs = [(i, f"subject{letters(i // 2)} matter{letters(i // 2)} of all") for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = frame.select("doc_id", (F.col("doc_id") % 4 < 2).cast("int").alias("toxic"))
    got = toxicity.digest(toxicity.score_documents(frame, known)).collect()
    twins = [r for r in got if r.held_out and zlib.crc32(str(r.doc_id ^ 1).encode()) % 5]
    assert len(twins) > 100 and all(r.evidence[0] == r.doc_id ^ 1 for r in twins)
    assert len({r.score for r in twins}) > 1


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        got = toxicity.score_documents(odd, labels)
        assert got.count() == odd.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert toxicity.reject_toxic(odd, labels).columns == odd.columns
    assert toxicity.score_documents(empty, some).count() == 0


# Segmentation ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces.load(PIECES, 1.0)


def plain_edges(block, model, sharpness):
    """The pieces at the start of a block by looking each one up in the model itself: (end, weight, ids)."""
    n, out = model.get_piece_size(), []
    for end in range(1, len(block) + 1):
        i = model.piece_to_id(block[:end].replace(" ", "\u2581"))
        if "\u2581" in block[:end] or i == model.unk_id() or model.is_byte(i) or model.is_control(i):
            continue
        score = model.get_score(i)
        out.append((end, ((-score if -n <= score <= 0 else n) + 2.7) ** -sharpness, (i,)))
    if not out or out[0][0] != 1:
        ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in block[0].encode())
        out.append((1, (n + 2.7) ** -sharpness, ids))
    return out


def every_segmentation(block, model, sharpness=1.0):
    if not block:
        return [((), 1.0)]
    return [(ids + rest, weight * w) for end, weight, ids in plain_edges(block, model, sharpness) for rest, w in every_segmentation(block[end:], model, sharpness)]


def samples(text, pieces, k, seeds):
    """For each seed the samples of text: (ids, log probability, perturbed one, inclusion)."""
    lattices = segmentation.Lattices(pieces)
    keys = segmentation.row_keys(pa.array([7] * seeds), pa.array(range(seeds)), 0)
    out = []
    for found in lattices.sample([text] * seeds, keys, k):
        own = []
        for path, inclusion in found:
            ids, _ = pieces.ids_of(lattices.mark.all[path.edges].astype(np.int64), np.array([len(path.edges)]))
            own.append((tuple(ids.tolist()), path.log_prob, path.perturbed, inclusion))
        out.append(own)
    return out


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("text", ["thereof", "abc", "\u00e9\u6f22", " ", "\u2581a", "the ten"])
def test_samples_follow_the_lattice(pieces, model, text):
    ways = Counter()
    blocks = segmentation.blocks_of(text)
    whole = [((), 1.0)]
    for block in blocks:
        whole = [(a + b, x * y) for a, x in whole for b, y in every_segmentation(block, model)]
    for ids, w in whole:
        ways[ids] += w
    total, n = sum(ways.values()), 4000
    runs = samples(text, pieces, 3, n)
    first = Counter(r[0][0] for r in runs)
    second = Counter(r[1][0] for r in runs if len(r) > 1)
    for ids, w in ways.most_common(5):
        p = w / total
        assert abs(first[ids] / n - p) < 0.035
        without = sum(q / total * p / (1 - q / total) for other, q in ways.items() if other != ids)
        assert abs(second[ids] / n - without) < 0.035
    for run in runs[:300]:
        assert len({s[0] for s in run}) == len(run) == min(3, len(ways))
        assert all(a[2] >= b[2] for a, b in zip(run, run[1:], strict=False))
        assert all(np.isclose(s[1], math.log(ways[s[0]] / total)) and 0 < s[3] <= 1 for s in run)


def test_inclusion_scores_weigh_samples_without_bias(pieces, model):
    """The sum over samples of p / inclusion estimates 1, the Horvitz-Thompson way."""
    runs = samples("thereof", pieces, 4, 3000)
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in run) for run in runs]) - 1) < 0.05


@pytest.mark.parametrize("block", ["the", "information", "   a"])
def test_alternatives_survive_rounding(model, block):
    sharp = segmentation.Pieces.load(PIECES, 6.0)
    ways = sorted((w for _, w in every_segmentation(" " + block, model, 6.0)), reverse=True)
    found = samples(block, sharp, 2, 5)
    assert all(len(f) == 2 for f in found) and np.isclose(max(s[1] for f in found for s in f), math.log(ways[0] / sum(ways)))


@pytest.mark.parametrize("text", ["information" * 400, "\u6570\u636e\u4e00\u4e2a" * 700, "x" * 5000])
def test_runs_without_spaces_have_one_lattice(pieces, model, text):
    """Every character of a long run can be inside a piece: no place is a cut in all samples."""
    assert segmentation.blocks_of(text) == [" " + text]
    runs = samples(text, pieces, 2, 12)
    assert all(len(f) == 2 and f[0][0] != f[1][0] for f in runs)
    if text[0] == "i":
        cuts = [set(np.cumsum([len(model.id_to_piece(i)) for i in ids]).tolist()) for run in runs for ids, *_ in run]
        assert len(set.intersection(*cuts)) < len(text) / 8


def test_runs_of_spaces_have_their_pieces(pieces, model):
    assert segmentation.blocks_of("a    b") == [" a", "    b"]
    assert any(len(model.id_to_piece(i).rstrip("b")) > 1 for run in samples("    b", pieces, 2, 20) for ids, *_ in run for i in ids)


def test_round_trips(spark, odd, empty):
    got = segmentation.encode_samples(odd, PIECES, k=2).collect()
    assert all(r.round_trip for r in got)
    by_id = Counter(r.doc_id for r in got)
    assert by_id[2] == 1 and by_id[4] == 2 and by_id[6] == 4
    again = segmentation.encode_samples(odd.repartition(3), PIECES, k=2).collect()
    assert {(r.doc_id, r.sample, r.ids) for r in again} == {(r.doc_id, r.sample, r.ids) for r in got}
    assert segmentation.encode_samples(empty, PIECES).count() == 0


def test_copies_have_samples_of_their_own(spark):
    rows = spark.createDataFrame([(1, "several words make a text", i) for i in range(3)], "doc_id long, text string, copy int")
    got = segmentation.encode_samples(rows, PIECES, k=1, copy=F.col("copy")).collect()
    assert len({bytes(r.ids) for r in got}) == 3


def test_a_cleared_cache_changes_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i} with words{i * 37} of its own") for i in range(300)], "doc_id long, text string").coalesce(1)
    keep = rows.collect()
    keys = segmentation.row_keys(pa.array([r.doc_id for r in keep]), pa.array([0] * 300), 0)
    pieces = segmentation.Pieces.load(PIECES, 1.0)
    probs = []
    for limit in (10, 1 << 20):
        monkeypatch.setattr(segmentation, "_CACHED", limit)
        lattices, own = segmentation.Lattices(pieces), []
        for i in range(0, 300, 50):
            own += [[p.log_prob for p, _ in f] for f in lattices.sample([r.text for r in keep[i : i + 50]], keys[i : i + 50], 2)]
        probs.append(own)
    assert np.allclose(probs[0], probs[1])


def test_decoding_agrees_with_the_library(pieces, model):
    for text in ["Plain words, and more.", "  two  spaces ", "\u00e9\U0001f600 \u6f22\u5b57\tx\ny", "\u2581 mark", "a\n\n b"]:
        for ids, *_ in samples(text, pieces, 4, 2)[0]:
            assert model.decode(list(ids)) == text == pieces.decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode()
        own = model.encode(text)  # the library itself reads a mark in the text as a space
        assert pieces.decode(np.array(own, np.int32), np.array([len(own)]))[0].decode() == model.decode(own)
