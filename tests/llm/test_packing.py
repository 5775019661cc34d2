"""Packing: pieces against the tokenizers library, bins that hold, few of them, on odd and empty tables."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexmill.llm import packing, token_files

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def check_sequences(rows, capacity):
    """Every piece lies in its sequence without a gap or an overlap."""
    by = defaultdict(list)
    for offset, length, sequence in rows:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["uniform", "thirds", "long", "tiny", "equal"])
def test_solutions_are_packings_and_get_no_worse(kind):
    rnd = np.random.default_rng(4)
    lengths = {"uniform": rnd.integers(1, 100, 900), "thirds": rnd.integers(30, 37, 900), "long": rnd.integers(51, 100, 300), "tiny": np.ones(500, int), "equal": np.full(301, 34)}[kind]
    first = packing.settle(lengths, 100, 4, rnd)
    last = packing.evolve(lengths, first, 100, 60, rnd)
    prices = [packing.cost(lengths, p, 100) for p in first]
    assert packing.cost(lengths, last[0], 100) <= min(prices) and min(prices)[0] >= packing.least_bins(lengths, 100)
    for p in [*first, *last]:
        assert len(p) == len(lengths) and p.min() == 0 and np.bincount(p, lengths).max() <= 100 and (np.bincount(p) > 0).all()


def test_the_bound_is_a_bound():
    """Against the true minimum of small instances."""
    rnd = random.Random(1)

    def fewest(items, rooms):
        if not items:
            return len(rooms)
        best, seen = len(items) + len(rooms), set()
        for i, room in enumerate(rooms):
            if room >= items[0] and room not in seen:
                seen.add(room)
                best = min(best, fewest(items[1:], [*rooms[:i], room - items[0], *rooms[i + 1 :]]))
        return min(best, fewest(items[1:], [*rooms, 10 - items[0]]))

    for _ in range(60):
        lengths = np.array([rnd.randint(1, 9) for _ in range(rnd.randint(1, 7))])
        true = fewest(sorted(lengths.tolist(), reverse=True), [])
        assert packing.least_bins(lengths, 10) <= true
        found = packing.evolve(lengths, packing.settle(lengths, 10, 4, np.random.default_rng(0)), 10, 40, np.random.default_rng(1))
        assert len(np.bincount(found[0])) >= true


def test_crossover_takes_whole_bins(monkeypatch):
    rnd = np.random.default_rng(7)
    lengths = rnd.integers(1, 60, 400)
    mine, other = packing.settle(lengths, 100, 2, rnd)
    kept = {frozenset(np.flatnonzero(other == b)) for b in range(other.max() + 1)}
    shared = []
    for seed in range(12):
        child = packing.crossover(lengths, mine, other, 100, np.random.default_rng(seed))
        assert np.bincount(child, lengths).max() <= 100
        shared.append(sum(frozenset(np.flatnonzero(child == b)) in kept for b in range(child.max() + 1)))
    assert max(shared) > 10


def test_shards_and_levels_pack_all_items(spark):
    """Many shards and levels: as few sequences as one shard makes, but for one in a hundred."""
    rnd = random.Random(9)
    lengths = [min(99, max(1, int(rnd.lognormvariate(3, 1)))) for _ in range(3000)] + [100] * 20
    items = spark.createDataFrame(list(enumerate(lengths)), "tag long, length long").repartition(5)
    got = packing.pack(items, capacity=100, shard=200, rounds=2, children=10).collect()
    assert sorted(r.tag for r in got) == list(range(len(lengths)))
    n = check_sequences([(r.offset, lengths[r.tag], r.sequence_id) for r in got], 100)
    bound = packing.least_bins(np.array(lengths), 100)
    assert bound <= n <= bound * 1.01 + 1
    again = packing.pack(items.repartition(3), capacity=100, shard=200, rounds=2, children=10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_documents_are_cut_and_packed(spark, odd, empty):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"word{rnd.randrange(300)}" for _ in range(rnd.choice([3, 30, 200, 900])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    whole = packing.pack_documents(docs, TOKENIZER, capacity=256)
    got = whole.collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted(((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect()), key=repr)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start == 256 * r.piece and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, tuple(ids.tolist())))
    assert sorted((i, p) for i, own in pieces.items() for p in own if i in (4, 5)) == sorted((i, (k // 256, ids[k : k + 256])) for i, ids in want if i in (4, 5) for k in range(0, len(ids), 256))
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    assert sorted((r.doc_id for r in got if r.piece == 0), key=repr) == sorted((i for i, _ in want), key=repr)
    check_sequences([(r.offset, r.length, r.sequence_id) for r in got], 256)
    rows = packing.sequences(whole).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows) and sum(r.n_tokens for r in rows) == sum(r.length for r in got)
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_words_of_an_encoder_take_little_memory_and_equal_hashes_differ(monkeypatch):
    """A worker's words are in flat arrays; words of one hash are told apart by their bytes."""
    words = [f"{chr(97 + i % 26)}{i:07d}x" for i in range(60_000)]
    words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    encoder = token_files.WordEncoder(TOKENIZER, 1_000_000)
    encoder.encode(["warm up"])
    tracemalloc.start()
    ids, sizes = encoder.encode([" ".join(words)])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 130 * len(words) and ids.tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    monkeypatch.setattr(token_files, "hash", lambda word: len(word) % 2, raising=False)
    odd = ["aa bb cc, dd aa", "", "bb. cc aa!? 12 12x Ä ä ça", "aa dd  bb\n\ncc"]
    clashing = token_files.WordEncoder(TOKENIZER)
    for _ in range(2):
        ids, sizes = clashing.encode(odd)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
        assert ids.tolist() == [x for own in want for x in own] and sizes.tolist() == [len(own) for own in want]


def test_known_words_of_an_encoder_are_never_python_strings(monkeypatch):
    """New plain words and heads go to the model once, known ones are found by their bytes; odd letters and equal hashes
    give the tokenizer's ids."""
    rnd = random.Random(5)
    letters = [*"abzéñıσςйאا中Éǅ́ͅİΣ", *",.!'|=<09"]
    words = sorted({"".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(3000)} | {"don't", "x's", "a.", "b.", "a", "été,"})
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    chars, seen = token_files._as_chars, []
    monkeypatch.setattr(token_files, "_as_chars", lambda part: seen.extend(part.to_pylist()) or chars(part))
    encoder = token_files.WordEncoder(TOKENIZER)
    for _ in range(2):
        ids, sizes = encoder.encode(words)
        assert ids.tolist() == [x for own in want for x in own] and sizes.tolist() == [len(own) for own in want]
    assert {"a", "b", "été"} <= set(seen) and len(seen) == len(set(seen))
    monkeypatch.setattr(token_files, "_hashes_of", lambda part: np.arange(len(part), dtype=np.uint64) % 2)
    clashing = token_files.WordEncoder(TOKENIZER)
    for _ in range(2):
        assert clashing.encode(words[:400])[0].tolist() == [x for own in want[:400] for x in own]
