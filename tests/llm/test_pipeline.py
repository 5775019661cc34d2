"""Each stage of the pipeline against brute force, and on odd and empty tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexmill.llm.common import made

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def toxic_corpus():
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        words = [f"w{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 12))}" for _ in range(30)] + (["trash", "scum", "moron"] if i % 4 == 0 else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), f"s{i % 3}"))
    return rows


def test_toxic_documents_go(spark, labels_dir):
    docs = toxic_corpus()
    kept = corpus_pipeline.drop_toxic(spark, frame(spark, docs), labels_dir)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id for r in kept.collect()}
    clean = {i for i, *_ in docs if i % 4}
    assert len(clean - got) <= 3 and len(got - clean) <= 3


def plain_lines(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")]  # noqa: E731 - ASCII texts
    holders = defaultdict(list)
    for i, t in rows:
        for k in set(keys(t)):
            holders[k].append(i)
    out = {}
    for i, t in rows:
        left, seen = [], set()
        for line, k in zip(t.split("\n"), keys(t), strict=True):
            repeats = len(k) >= 20 and len(holders[k]) >= (2 if len(k.split()) >= 50 else 10)
            if not repeats or (min(holders[k]) == i and k not in seen):
                left.append(line)
                seen.add(k)
        if left or t == "":
            out[i] = "\n".join(left)
    return out


def test_repeated_lines_go(spark):
    rnd = random.Random(3)
    common = ["A common line of more than twenty", "short one", " ".join(f"long{i}" for i in range(55)), " ".join(f"near{i}" for i in range(49))]
    rows = []
    for i in range(60):
        lines = [f"own line number {i} {j}" for j in range(rnd.randint(0, 3))] + [common[0]] * (i % 3 == 0) + [common[1]] * (i % 2) + [common[2].upper()] * (i in (7, 9)) + [common[3]] * (i in (8, 9))
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, frame(spark, [(i, t, "s") for i, t in rows]), "").collect()}
    assert got == plain_lines(rows)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(10):
        base = [f"w{g}x{i}" for i in range(60)]
        for _ in range(rnd.randint(1, 5)):
            rows.append((rnd.randint(0, 25), " ".join(w if rnd.random() > 0.01 else "other" for w in base)))
    rows += [(3, "twice the same row"), (3, "twice the same row"), (30, ""), (31, ""), (None, "twice the same row")]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in rows]), "").collect()
    want = Counter(min(ids) if ids[0] is not None else None for ids in groups.values())
    assert Counter(r.doc_id for r in got) == want and all((r.doc_id, r.text) in rows for r in got)


def test_mixed_sources_near_their_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{min(i % 5, 2)}") for i in range(400)]
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    total, taken = sum(sizes.values()), Counter()
    got = corpus_pipeline.mix_sources(spark, frame(spark, rows), "").collect()
    for r in got:
        taken[r.source] += len(r.text.split())
    weight = {"s0": 5, "s1": 2, "s2": 1}
    over = {s for s in sizes if total * weight[s] / 8 > 3 * sizes[s]}
    left = total - sum(3 * sizes[s] for s in over)
    for s in sizes:
        want = 3 * sizes[s] if s in over else left * weight[s] / sum(w for x, w in weight.items() if x not in over)
        assert abs(taken[s] - want) <= 9
    assert max(Counter(r.doc_id for r in got).values()) <= 3


def test_every_copy_is_encoded(spark):
    rows = [(1, "several words make this text of some length", "s")] * 3 + [(2, "", "s"), (3, None, "s"), (None, "no id", "s"), (None, "no id", "s")]
    got = corpus_pipeline.encode(spark, frame(spark, rows), "").collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got) and len({bytes(r.ids) for r in got if r.doc_id == 1}) == 3


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_odd_rows(spark, odd, empty, labels_dir, stage):
    got = stage(spark, odd, labels_dir)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == odd.columns and {r.size for r in got.select("size").collect()} == {"clash"}
    assert got.count() >= 9 or stage is corpus_pipeline.mix_sources
    assert stage(spark, empty, labels_dir).count() == 0


def test_run_gives_the_stages_one_after_the_other(spark, labels_dir, tmp_path):
    docs = frame(spark, toxic_corpus()[:120] + [(500, "own words here\nand there", "s1"), (501, "own words here\nand there", "s1")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{labels_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    before = set(made())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [p for p in made() if p not in before]
    assert len(left) == 1 and "/after-mixing-" in left[0]  # all else that was staged is gone
    ids = {r.doc_id for r in got}
    assert not ids & {501} and all(r.round_trip for r in got) and sum(i % 4 == 0 and i < 400 for i in ids) <= 1


#: Names that the stages' operators give to columns of their own.
ADDED = ["n_lines", "n_dropped", "copies", "target", "source_size", "size", "score", "text_id", "group_id", "n", "copy", "kept", "id"]


def test_columns_named_like_what_stages_add_come_through(spark, labels_dir):
    rows = [(i, f"text of its own {i} with words {i * i}\n" + "A line that very many documents hold here" * (i % 2), f"s{i % 3}") for i in range(40)]
    docs = frame(spark, rows)
    for name in ADDED:
        docs = docs.selectExpr("*", f"'mine' || doc_id AS {name}")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        kept = stage(spark, docs, labels_dir)
        assert kept.dtypes == docs.dtypes
        got = kept.collect()
        assert got and all(r[name] == f"mine{r.doc_id}" for r in got for name in ADDED)


def test_samples_don_t_depend_on_partitions(spark):
    rows = [(None, "same text without an id", "s")] * 3 + [(None, "another text without an id", "s"), (1, "with an id", "s"), (1, "with an id", "s"), (2, None, "s"), (None, None, None)]
    docs = frame(spark, rows)
    got = [sorted((repr(r.doc_id), bytes(r.ids)) for r in corpus_pipeline.encode(spark, d, "").collect()) for d in (docs.coalesce(1), docs.repartition(5))]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(7, "one text that is here several times", f"s{i}") for i in range(6)]
    kept = [corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).repartition(n), "").collect() for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_copies_are_sampled_together_and_none_is_lost(spark):
    """The copies of a document have distinct samples while its text has as many; then they are given in turn."""
    rows = [(1, "several words make this text of some length", "s")] * 40 + [(2, None, "s")] * 3 + [(3, "a", "s")] * 20 + [(4, "one copy alone", "s")]
    got = corpus_pipeline.encode(spark, frame(spark, rows), "").collect()
    assert Counter(r.doc_id for r in got) == {1: 40, 2: 3, 3: 20, 4: 1} and all(r.round_trip for r in got)
    first = [r for r in got if r.doc_id == 1]
    assert max(r.sample for r in first) == corpus_pipeline.TOGETHER - 1
    assert len({bytes(r.ids) for r in first}) >= 16 and Counter(r.sample for r in first) == {n: 3 - (n >= 8) for n in range(16)}
