"""The operators on documents against brute force, and on odd and empty tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import fingerprints, line_dedup, mixing, near_dedup, secrets, sharding, token_files
from lexmill.llm.common import span_hashes, text_slices

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# Near-duplicates -------------------------------------------------------------------------------------------------------


def shingles(text, words):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(docs, words, percent):
    sets = {i: shingles(t, words) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    docs = []
    for base in range(12):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 9)):
            copy = [w if rnd.random() > 0.02 else f"x{rnd.random()}" for w in words]
            docs.append((len(docs) * 7 % 1009, "  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy)))
    for words in (4, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, words, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_mixed_group(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w if rnd.random() > rnd.choice([0.0, 0.01, 0.03, 0.06]) else f"x{rnd.random()}" for w in base)) for i in range(300)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 4, 80)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for g in range(6):
        one, two = ([f"{side}{g}x{i}" for i in range(80)] for side in "ab")
        near = [w if i else "changed" for i, w in enumerate(one)]
        rows += [(10 * g, " ".join(one)), (10 * g, " ".join(two)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(two))]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g, 10 * g + 2: 10 * g}
    rnd.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    groups = defaultdict(set)
    for r in got:
        groups[r.group_id].add((r.doc_id, r.text_id))
    assert sorted(map(len, groups.values())) == [2] * 12


def test_small_blocks_change_nothing(spark, monkeypatch):
    """Buckets of several components, in parts of two members, one component larger than a part."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w if rnd.random() > rnd.choice([0.0, 0.01, 0.03, 0.06]) else f"x{rnd.random()}" for w in base)) for i in range(120)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 4, 80)


def test_sketches_refuse_no_pair_above_the_threshold():
    rnd = np.random.default_rng(2)
    refused = 0
    for n in (100, 400, 512, 600, 2000, 20_000):
        for _ in range(150):
            apart = n // 9  # (n - apart) / (n + apart) is just 0.8 or more
            with np.errstate(over="ignore"):
                whole = near_dedup.mix(rnd.integers(1, 1 << 62, n + apart).astype(np.uint64))
            sets = [np.sort(whole[:n]), np.sort(whole[apart:])]
            assert 100 * len(np.intersect1d(*sets)) >= 80 * len(np.union1d(*sets))
            one, two = (np.frombuffer(near_dedup.odd_sketch(s), np.uint64)[None] for s in sets)
            refused += not near_dedup.may_link(one, two, np.array([n]), np.array([n]), 80)[0]
    assert refused == 0


def test_sketch_estimates_high_similarity():
    rnd = np.random.default_rng(1)
    for n in (50, 400, 5000):
        whole = rnd.integers(1, 1 << 62, n + n // 4).astype(np.uint64)
        with np.errstate(over="ignore"):
            sets = [np.unique(near_dedup.mix(x)) for x in (whole[:n], whole[n // 8 : n + n // 8])]
            one, two = (np.frombuffer(near_dedup.odd_sketch(s), np.uint64)[None] for s in sets)
        got = near_dedup.sketch_similarity(one, two, np.array([n]), np.array([n]))[0]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(got - true) < (near_dedup.WHOLE_MARGIN if n <= near_dedup.SKETCH_SAMPLES else near_dedup.SAMPLED_MARGIN)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, 4).collect()]
    assert len(got) == odd.count()
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [x[2:] for x in got if x[0] is None] == [(None, True)] * 2
    assert {x[2] for x in got if x[0] == 8} == {7} and sum(x[0] == 6 and x[2] == 6 for x in got) == 2
    assert near_dedup.near_duplicates(empty).count() == 0


# Token files -----------------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd, path, TOKENIZER)
    whole = Tokenizer.from_file(TOKENIZER)
    at = 0
    want = []
    rows = sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(token_files.index_token_files(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [4]).collect()] == [4]


def test_word_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(TOKENIZER), token_files.WordEncoder(TOKENIZER)
    for text in ["don't STOP, Σίσυφος ΑΣ. İstanbul", "a\x1cb c   x ﬁ①!!", "é É. 漢字,かな 12345...", "x<|endoftext|> y", "\n\n", "été.\r\nOk"]:
        assert words.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    many = ["some words, more WORDS.", "", "x y z!!!", "some words"] * 3
    ids, sizes = words.encode(many)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in many]


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write_token_files(empty, str(tmp_path / "t"), TOKENIZER)
    assert token_files.index_token_files(spark, str(tmp_path / "t")).count() == 0


# Lines -----------------------------------------------------------------------------------------------------------------


def plain_key(line):
    """The key by the contract: bare of ASCII white space at both ends, A-Z in lower case."""
    blank = [" ", *map(chr, range(9, 14))]
    while line and line[0] in blank:
        line = line[1:]
    while line and line[-1] in blank:
        line = line[:-1]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def plain_lines(texts, min_chars, min_docs):
    count = Counter(k for t in texts for k in {plain_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        left = [x for x in lines if count[plain_key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("chars", "docs", "broadcast"), [(1, 3, True), (4, 2, True), (1, 2, False)])
def test_lines_equal_brute_force(spark, monkeypatch, chars, docs, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BITS", 1)
    rnd = random.Random(chars)
    lines = ["a", " A", "bb", "ccc\t", "Dddd", "dddd ", "", "  ", "\u00e9\u00c9", "\u00e9\u00c9 \x0b", "unique", "\x85x", "\xa0y"]
    texts = ["\n".join(rnd.choice(lines) + rnd.choice(["", str(rnd.randint(0, 30))]) for _ in range(rnd.randint(0, 8))) for _ in range(40)] + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(line_dedup.drop_repeated_lines(frame, chars, docs)).collect()}
    assert got == dict(enumerate(plain_lines(texts, chars, docs)))


def test_line_filters_hold_every_repeat_and_little_else(spark, monkeypatch):
    """With many ranges and hand-overs a task, the filters lose no repeated key and suspect few others."""
    monkeypatch.setattr(line_dedup, "RANGE_HASHES", 256)
    monkeypatch.setattr(line_dedup, "HELD_HASHES", 100)
    docs = [(i, "\n".join([f"own line {i} {j}" for j in range(20)] + [f"shared {i % 500}"])) for i in range(1000)]
    twice, n = line_dedup.repeated_hashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert 500 <= n < 540
    bits = line_dedup.twice_filter(twice, n)
    keys = pa.array([f"shared {i}" for i in range(500)] + [f"own line {i} {j}" for i in range(500) for j in range(20)])
    hit = np.concatenate([line_dedup.in_filter(bits, span) for _, data, off in text_slices(keys) for span in [span_hashes(data, off[:-1], off[1:])]])
    assert hit[:500].all() and hit[500:].mean() < 0.01


def test_a_filter_beyond_one_machine_suspects_the_same(spark, monkeypatch):
    """With segments of 64 hashes that stay with tasks: the same keys as with a broadcast filter, and suspects alone."""
    docs = [(i if i % 9 else None, "\n".join([f"own line {i} {j}" for j in range(12)] + [f"shared {i % 90}", f"Shared {i % 70} "])) for i in range(400)] + [(7, None), (8, ""), (9, "shared 1"), (9, "shared 1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(line_dedup, "RANGE_HASHES", 64)
    want = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(frame, 1, 3).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BITS", 1)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(frame, 1, 3).collect()) == want
    twice, n = line_dedup.repeated_hashes(frame)
    suspects = [r.key for r in line_dedup._suspects(frame, twice, n, 1).collect()]
    assert sum(k.startswith("own") for k in suspects) < 40 and sum(k.startswith("shared") for k in suspects) == sum(len({i % 90, i % 70}) for i in range(400)) + 2


def test_rows_that_share_an_id_keep_lines_of_their_own(spark):
    rows = [(1, "x\nmine"), (1, "yours\nx"), (None, "x\nz"), (None, "own"), (None, "x\nz")]
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1, 3).collect())
    assert got == Counter([(1, "mine", 1), (1, "yours", 1), (None, "z", 1), (None, "own", 0), (None, "z", 1)])


def test_first_line_stays(spark):
    frame = spark.createDataFrame([(3, "x\ny"), (1, "y\nz\ny"), (2, "y")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame, 1, 2, keep_first=True).collect()}
    assert got == {1: "y\nz", 2: "", 3: "x"}


def test_pipeline_drops_long_lines_of_two_documents(spark):
    long, short = " ".join(f"word{i}" for i in range(50)), " ".join(f"word{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"own one\n{long}\n{short}"), (2, f"own two\n{long.upper()}\n{short}")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {1: f"own one\n{long}\n{short}", 2: f"own two\n{short}"}


def test_lines_of_odd_rows(odd, empty):
    got = line_dedup.drop_repeated_lines(odd, 1, 4)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.count() == odd.count()
    assert {r.text for r in got.filter("doc_id IN (7, 8)").collect()} == {"other words \U0001f600 é 漢字 x"}
    assert [r.n_lines for r in got.filter("doc_id = 1").collect()] == [1]
    assert line_dedup.drop_repeated_lines(empty).count() == 0


# Mixing ----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}
        left -= over


def test_mix_nears_its_targets(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join("w" * 1 for _ in range(rnd.choice([0, 1, 5, 40, 200]))), None if i % 7 == 6 else f"s{min(i % 11, 4)}") for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.copies(frame, [5.0, 2.0, 1.0]).collect()
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(text.split())
    want = brute_targets(sizes, [5.0, 2.0, 1.0], 3.0)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 200 for s in sizes)
    again = mixing.copies(frame.repartition(7), [5.0, 2.0, 1.0]).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}
    assert mixing.mix(frame, [5.0, 2.0, 1.0]).count() == sum(r.copies for r in rows)


def test_pivot_keeps_totals_and_expectations():
    w, p = np.array([50.0, 20, 7, 3, 3, 1]), np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.4])
    draws = np.array([mixing.pivot(w, p, np.random.default_rng(i))[0] for i in range(4000)])
    assert np.allclose(draws @ w, w @ p) and (((draws > 1e-9) & (draws < 1 - 1e-9)).sum(axis=1) <= 1).all()
    assert np.abs(draws.mean(axis=0) - p).max() < 0.04
    with_tail = [mixing.pivot(w, p, np.random.default_rng(i), 500.0, 0.5) for i in range(4000)]
    assert all(np.isclose(d @ w + 500 * t, w @ p + 250) and set(d) <= {0.0, 1.0} for d, t in with_tail)
    assert abs(np.mean([t for _, t in with_tail]) - 0.5) < 0.01


def test_each_row_keeps_its_expectation(spark):
    """Over many seeds a row of any size is taken target / source_size times."""
    docs = spark.createDataFrame([(i, "w " * (1 + 40 * (i % 7 == 0) + i % 3), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mixing.copies(docs, [5.0, 1.0], seed=seed).collect():
            total[r.source] += r.copies - r.target / r.source_size
    assert all(abs(x) / (12 * 20) < 0.1 for x in total.values())


def test_rows_alike_share_the_copies(spark):
    rows = [(1, "a b c", "s", "x")] * 50 + [(2, "d e f", "s", "y")] + [(None, "g h", None, None)] * 7
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)
    got = Counter((r.doc_id, r.text, r.size) for r in mixing.mix(frame, [5.0, 1.0]).collect())
    assert set(got) <= {(1, "a b c", "x"), (2, "d e f", "y"), (None, "g h", None)}
    want = brute_targets({"s": 153, None: 14}, [5.0, 1.0], 3.0)
    assert abs(got[1, "a b c", "x"] * 3 + got[2, "d e f", "y"] * 3 - want["s"]) <= 3 and abs(got[None, "g h", None] * 2 - want[None]) <= 2


def test_mix_of_odd_rows(odd, empty):
    got = mixing.copies(odd, [5.0, 2.0, 1.0])
    assert got.count() == odd.count() and got.filter("size = 0 AND doc_id IN (1, 2, 3)").count() == 3
    mixed = mixing.mix(odd, [5.0, 2.0, 1.0])
    assert mixed.columns == odd.columns and {(r.size, r.copies) for r in mixed.collect()} == {("clash", "clash")}
    assert mixing.copies(empty, [1.0]).count() == 0 and mixing.mix(empty, [1.0]).count() == 0


# Fingerprints ----------------------------------------------------------------------------------------------------------


def plain_winnow(text, gram, window):
    with np.errstate(over="ignore"):
        points = np.array([ord(c) for c in text], np.uint32)
        grams = [int(fingerprints.gram_hashes(points[i : i + gram], gram)[0]) for i in range(len(text) - gram + 1)] if len(text) >= gram else [int(fingerprints.gram_hashes(points, len(text))[0])]
    window = min(window, len(grams))
    chosen = []
    for i in range(len(grams) - window + 1):
        least = min(grams[i : i + window])
        at = max(j for j in range(i, i + window) if grams[j] == least)
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [grams[i] for i in chosen], chosen


@pytest.mark.parametrize(("gram", "window"), [(1, 3), (5, 4), (16, 32), (7, 7)])
def test_winnowing_equals_plain_loops(gram, window):
    rnd = random.Random(gram)
    for n in (1, 2, gram, gram + 1, 60, 200):
        text = "".join(rnd.choice("ab \U0001f600") for _ in range(n))
        hashes, at = fingerprints.winnow(text, gram, window)
        assert (hashes.tolist(), at.tolist()) == plain_winnow(text, gram, window)


def test_shared_passages_share_a_hash():
    rnd = random.Random(2)
    draw = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = draw(fingerprints.GRAM + fingerprints.WINDOW - 1)
    one, two = (set(fingerprints.winnow(draw(300) + passage + draw(200))[0].tolist()) for _ in range(2))
    assert one & two


def test_fingerprints_of_odd_rows(spark, odd, empty):
    got = sorted(fingerprints.fingerprint_documents(odd).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    text = {i: t or "" for i, t in texts_of(odd)}
    edited = text[9][: len(text[9]) - len(text[9]) // 2] + text[8][: len(text[9]) // 2]
    assert by_id[9].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by_id[9].n_chars == len(text[9])
    assert by_id[8].near_next == 1.0 and by_id[8].fingerprint == by_id[7].fingerprint
    assert by_id[1].fingerprint == "" and by_id[2].near_next == 1.0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    alone = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert [r.near_next for r in alone] == [1.0]


def plain_likeness(one, two):
    """The likeness of two texts by loops of its own: grams hashed one by one, windows, sets."""
    sets = [set(plain_winnow(t, fingerprints.GRAM, fingerprints.WINDOW)[0]) if t else set() for t in (one, two)]
    return 1.0 if not any(sets) else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_likenesses_equal_plain_loops(spark):
    rnd = random.Random(12)
    texts = {i: "".join(rnd.choice("abcd efgh\n\U0001f600") for _ in range(rnd.choice([0, 1, 9, 15, 16, 47, 90, 130]))) for i in range(30)}
    texts[7], texts[6] = texts[20] + texts[21], texts[20] + texts[22]
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i])
        edited = texts[i][: n - n // 2] + texts[j][: n // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n
        assert abs(got[i].near_edited - plain_likeness(texts[i], edited)) < 1e-12 and abs(got[i].near_next - plain_likeness(texts[i], texts[j])) < 1e-12


def test_next_document_over_partitions(spark):
    texts = {i: f"text number {i} " * (i % 5 + 1) for i in range(0, 400, 3)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_documents(frame).collect()}
    assert got == {i: hashlib.sha256(fingerprints.edited_text(texts[i], texts[following[i]]).encode()).hexdigest() for i in texts}


# Secrets ---------------------------------------------------------------------------------------------------------------


def plain_spans(text):
    import re

    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))


def test_secret_spans_equal_plain_patterns(spark, odd):
    hexes = "0123456789abcdef" * 2
    texts = [f"é\U0001f600 Token: '{hexes}' x", "secret: token : abcdefgh password=short api_key = \"LongEnough1\"", f"AKIA{'A' * 16} AKIAB AKIA{'9' * 30}x", "\x01token=abcdefg\x02 SECRET=\"x.y=z/1\"", "passwd password=aaaaaa" * 3, f"{hexes}g{hexes}"] + [t for _, t in texts_of(odd)]
    frame = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(frame)).collect()}
    for i, text in enumerate(texts):
        spans = plain_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text[:80]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_ownership_parts_examples_from_live_tokens(spark):
    common, own = "EXAMPLEtoken1234567890abcd", "Zx9Qw8Er7Ty6Ui5Op4As3Df2"
    rows = [(i, f"see {common} here", f"owner{i}") for i in range(4)] + [(10, f"key {own} end", "owner1"), (11, "clean words only, nothing more", "owner2")]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_owners=2)).collect()}
    assert got[10].spans == f"token:4:{4 + len(own)}" and got[10].n_live == 1
    assert got[0].spans == "" and got[0].n_widespread == 1 and got[11].spans == ""


def test_one_owner_with_many_repositories_copies_an_example(spark, monkeypatch):
    example, own = "EXAMPLEtoken1234567890abcd", "Zx9Qw8Er7Ty6Ui5Op4As3Df2"
    rows = [(i, f"file {i} see {example} here", "one") for i in range(12)] + [(100 + i, f"the same file with {own} end", "one") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (10, 0):
        monkeypatch.setattr(secrets, "BROADCAST_HASHES", limit)
        got = {r.doc_id: r for r in secrets.digest(secrets.scan(frame, max_owners=2, max_repositories=8)).collect()}
        assert all(got[i].spans == "" and got[i].n_widespread == 1 and got[i].n_live == 0 for i in range(12))
        assert all(got[100 + i].n_live == 1 and got[100 + i].spans.startswith("token:") for i in range(30))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:06d}" for i in range(3000))
    (got,) = secrets.digest(secrets.scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"))).collect()
    assert got.n_assign == 3000 and got.base_sha256 == hashlib.sha256(",".join(f"assign:{13 * i}:{13 * i + 12}" for i in range(3000)).encode()).hexdigest()


def test_secrets_of_odd_rows(odd, empty):
    got = secrets.digest(secrets.scan(odd))
    assert got.count() == odd.count() and [r.n_assign for r in got.filter("doc_id = 9").collect()] == [1]
    assert secrets.scan(empty).count() == 0


# Shards ----------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    frame = spark.createDataFrame([(i, f"t{i % 50}", "x") for i in range(3000)], "doc_id long, text string, slot string").repartition(5)
    rows = sharding.shard_documents(frame, [1.0] * 8).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.text_crc32 == zlib.crc32(f"t{r.doc_id % 50}".encode()) and r.size == len(f"t{r.doc_id % 50}") + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(300 < len(s) < 450 for s in slots.values()) and 250 < sum(r.grown_shard == 8 for r in rows) < 420
    again = sharding.shard_documents(frame.repartition(3), [1.0] * 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    got = sharding.shard_documents(odd, [1.0] * 8)
    assert got.count() == odd.count() and {r.size for r in got.filter("doc_id = 1").collect()} == {1}
    assert sharding.shard_documents(empty, [1.0]).count() == 0


def test_shard_weights(spark):
    frame = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0, 0.0]).alias("s"))
    got = {r.s: r["count"] for r in frame.groupBy("s").count().collect()}
    assert set(got) == {0, 1} and abs(got[1] / 20_000 - 0.75) < 0.02


def plain_shard(key, weights, seed):
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(("\0null" if key is None else str(key)).encode(), 42)
        for number in (seed, shard):
            h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), h)
        score = -weight / math.log(((h >> 11) + 0.5) / 2**53) if weight else -1.0
        if best is None or score > best[0]:
            best = (score, shard)
    return best[1]


def test_shards_equal_brute_force(spark):
    keys = [None, *range(-3, 400)]
    frame = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    for weights in ([1.0] * 8, [1.0, 2.5, 0.0, 0.5]):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(frame, weights, grown=1.0, seed=3).collect()}
        assert got == {k: (plain_shard(k, weights, 3), plain_shard(k, [*weights, 1.0], 3)) for k in keys}


def test_slots_of_many_pieces(spark):
    frame = spark.createDataFrame([(i // 3, i % 2, "x") for i in range(2000)], "doc_id long, shard int, bucket string")
    got = sharding.slots(frame, "shard", "doc_id", ["doc_id"], bucket_rows=50)
    assert got.columns == ["doc_id", "shard", "bucket", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert {k: sorted(v) for k, v in slots.items()} == {0: list(range(1000)), 1: list(range(1000))}


# Token files' layout ---------------------------------------------------------------------------------------------------


def test_orc_layout(spark, tmp_path):
    """Stripes, row index stride, run-length encoding and Bloom filters as the files themselves state them."""
    rows = [(i * 3, " ".join(f"word{(i * 7 + j) % 50}" for j in range(20))) for i in range(20_000)]
    path = str(tmp_path / "t")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, TOKENIZER, stripe_bytes=1 << 16, index_rows=1000)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc.OrcFile
    last, stripes = -1, 0
    for name in sorted(f for f in os.listdir(path) if f.endswith(".orc")):
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), orc.readerOptions(conf))
        if not reader.getNumberOfRows():
            continue
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        own = reader.getStripes()
        stripes += own.size()
        columns = list(reader.getSchema().getFieldNames())
        number = 1 + columns.index("doc_id")
        stats = reader.getStripeStatistics()
        spans = sorted((stats[i].getColumnStatistics()[number].getMinimum(), stats[i].getColumnStatistics()[number].getMaximum()) for i in range(own.size()))
        assert spans[0][0] > last and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        last = spans[-1][1]
        records = reader.rows()
        footer = records.readStripeFooter(own[0])
        kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        assert {(number, "ROW_INDEX"), (number, "BLOOM_FILTER_UTF8")} <= kinds
        assert footer.getColumns(number).getKind().toString() == "DIRECT_V2"  # run-length encoding, version 2
        assert footer.getColumns(2 + columns.index("tokens")).getKind().toString() == "DIRECT_V2"
        records.close()
    assert stripes > 3
    few = token_files.read_token_files(spark, path, [9, 8997])
    assert sorted(r.doc_id for r in few.collect()) == [9, 8997]
