"""The law graph, retrieval, cases and streaming, on small rows, against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators import cases, extraction, graph, quality, search
from lexmill.streaming.incremental import follow_folder


def nodes(spark):
    rows = [("l", "1", 0, "سجن من 1 إلى 2 سنة، انظر المادة 2"), ("l", "2", 1, "قتل"), ("l", "2", 2, "قتل ثان")]
    return graph.article_nodes(spark.createDataFrame(rows, "law_id string, article_number string, pos int, text string"))


def test_graph_invariants(spark):
    a = nodes(spark)
    tables, edges = graph.build_facts(a, extraction.penalties(a), extraction.definitions(a), extraction.references(a), extraction.topics(a))
    ids = {r.id for frame in tables.values() for r in frame.select("id").collect()}
    found = edges.collect()
    assert all(e.dst_id in ids and (e.src_id in ids or e.src_id == "l") for e in found)
    assert Counter(e.rel for e in found)["REFERENCES"] == 2  # both articles 2
    stats = {(r.kind, r.name): r.n for r in graph.statistics(tables, edges, spark).collect()}
    assert stats["node", "Article"] == 3 and stats["node", "Table"] == 0 and stats["edge", "CONTAINS"] == 3


def test_amendments_apply_in_order(spark):
    a = nodes(spark)
    rows = [("m1", "l", "1", "2001-01-01", "modification", ["1", "9"], "one"), ("m2", "l", "2", "2002-01-01", "addition", ["9"], "two"), ("m3", "l", "3", "2003-01-01", "modification", ["9", "1"], "three")]
    m = spark.createDataFrame(rows, "amendment_id string, law_id string, amendment_law_number string, amendment_date string, amendment_type string, amended_article_numbers array<string>, description string")
    all_articles, edges = graph.apply_amendments(a, m)
    versions = {(r.article_number, r.version): r.id for r in all_articles.collect() if r.version}
    assert set(versions) == {("1", "2001-01-01"), ("9", "2002-01-01"), ("9", "2003-01-01"), ("1", "2003-01-01")}
    over = {(e.src_id, e.dst_id) for e in edges.filter("rel = 'SUPERSEDES'").collect()}
    first = a.filter("article_number = '1'").first().id
    assert over == {(versions["1", "2001-01-01"], first), (versions["1", "2003-01-01"], first), (versions["9", "2003-01-01"], versions["9", "2002-01-01"])}
    affected = {r.amendment_id: r.affected for r in graph.affected_articles(m, edges, all_articles).collect()}
    assert affected == {"m1": ["1"], "m2": ["9"], "m3": ["1", "9"]}
    assert graph.latest_article(all_articles, "l", "1").first().version == "2003-01-01"
    assert graph.latest_article(all_articles, "l", "1", originals_first=True).first().version is None


def test_paths_and_ranks(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.node, r.distance) for r in graph.within_hops(pairs, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {("b", 1), ("c", 2)}
    ranks = {r.node: r["rank"] for r in graph.pagerank(pairs, rounds=30).collect()}
    assert abs(ranks["b"] - (0.15 + 0.85 * ranks["a"])) < 1e-3


def test_bm25_equals_plain_python(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 12)))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b a"), (1, "zz")], "query_id int, question string")
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(frame, asked).collect()}
    words = {i: t.split() for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    for i, ws in words.items():
        want = sum(idf[q] * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for q in "aba" if q in ws)
        assert abs(got.get((0, i), 0) - want) < 1e-9
    assert not any(q == 1 for q, _ in got)


def test_fusion(spark):
    lexical = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 5, 1)], "query_id int, doc_id int, rank int")
    vector = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id int, doc_id int, rank int")
    got = {(r.query_id, r.doc_id): (r.fused, r.score) for r in search.fuse(lexical, vector).collect()}
    assert abs(got[0, 2][0] - (0.4 / 62 + 0.6 / 61)) < 1e-12
    assert got[0, 2][1] == 1 and got[0, 1][1] == 0 and got[1, 5][1] == 0  # a hit alone is 0


def test_questions(spark):
    asked = spark.createDataFrame([(0, "ما نص المادة ٢٣٦ من قانون العقوبات؟"), (1, "مادة (86 مكرر) في قانون الطوارئ"), (2, "لا شيء")], "query_id int, question string")
    got = [r.n for r in asked.select("query_id", search.asked_article(F.col("question")).alias("n")).orderBy("query_id").collect()]
    assert got == ["236", "86 مكرر", None]
    from lexmill.sources.text_files import law_registry

    assert [r.law_id for r in search.asked_law(asked, law_registry(spark)).orderBy("query_id").collect()] == ["penal_code", "emergency_law", None]


def test_retrieval_pins_the_named_article(spark):
    embedder = search.HashingEmbedder(32)
    rows = [("a1", "penal_code", "236", "ضرب أفضى إلى موت"), ("a2", "penal_code", "1", "سرقة ليلا"), ("a3", "emergency_law", "1", "حالة الطوارئ")]
    articles = search.embedded(spark.createDataFrame(rows, "id string, law_id string, article_number string, text string"), "text", embedder)
    assert search.same_dimension(articles) == 32
    q = "سرقة المادة 236 من قانون العقوبات"
    questions = spark.createDataFrame([(0, q, embedder.embed([q])[0].tolist())], "query_id int, question string, query_embedding array<float>")
    from lexmill.sources.text_files import law_registry

    hits = search.retrieve(articles, questions, law_registry(spark), threshold=0.0).orderBy(F.desc("pinned"), F.desc("score")).collect()
    assert (hits[0].id, hits[0].pinned, hits[0].score) == ("a1", True, 1.0) and {h.id for h in hits} == {"a1", "a2", "a3"}


def test_case_entities(spark):
    answers = [(1, "d1", '```json\n{"charges": [{"law_code": "قانون العقوبات", "article_number": "٢٣٦", "description": "x"}]}\n```'), (1, "d2", '[{"charges": [{"law_code": "penal_code", "article_number": "236", "description": "x"}, {"description": null}]}]'), (2, "d3", "broken")]
    frame = spark.createDataFrame(answers, "case_id int, doc_id string, answer string")
    got = cases.entities(frame, "charges", "law_code string, article_number string, description string").collect()
    assert sorted((r.case_id, r.law_code, r.article_number, r.source_document_id) for r in got if r.law_code) == [(1, "penal_code", "236", "d1")]
    assert sum(r.law_code is None for r in got) == 1  # a row without any key stays


def test_model_is_asked_again(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def answer(self, prompt):
            self.n += 1
            if prompt == "paid":
                raise RuntimeError("402 payment")
            return "" if self.n < 3 else "{}"

    prompts = spark.createDataFrame([("p",), ("paid",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.error) for r in cases.ask(prompts, Flaky(), sleep=lambda s: None).collect()}
    assert got["p"] == ("{}", None) and got["paid"][1].startswith("402")


def test_verdicts_and_quality(spark):
    answers = spark.createDataFrame([(1, '{"verdict": "guilty", "confidence_score": 0.5, "per_charge_rulings": [{"reasoning": "a"}, {"reasoning": "b"}]}'), (2, "[]"), (3, "?")], "case_id int, answer string")
    got = {r.case_id: (r.verdict, r.reasoning, r.status) for r in cases.verdicts(answers).collect()}
    assert got == {1: ("guilty", "a\n\nb", "ok"), 2: (None, None, "unparsed"), 3: (None, None, "unparsed")}
    report = spark.createDataFrame([(1, 2, 90, 1, 0, 1, 0), (20, 0, 0, 0, 0, 0, 0)], "issues int, warnings int, coverage int, terms int, refs int, topics int, rules int")
    assert [r.score for r in quality.score(report).collect()] == [95, 0]


def test_new_files_run_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    run = lambda: follow_folder(spark, str(tmp_path / "in"), lambda b: b.select("path", F.decode("content", "UTF-8").alias("text")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("two")
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_bm25_answers_more_than_ten_thousand_queries(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "epsilon zeta")], "doc_id long, text string")
    queries = spark.range(10_050).select(F.col("id").alias("query_id"), F.lit("alpha").alias("question"))
    assert search.bm25(docs, queries).select("query_id").distinct().count() == 10_050


def test_bm25_reads_texts_once_and_shuffles_no_pairs(spark, monkeypatch):
    texts = ["a b_c a", "é-b٣ a", None, "", "..., \x0b", "b_c b_c x", *[f"w{i % 5} a" * (i % 3) for i in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a a b_c w3"), (2, "b٣ x"), (3, "none"), (4, "w1a w4")], "query_id long, question string")
    found = search.bm25(docs, asked)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    also = spark.createDataFrame([(1, 5), (2, 0)], "query_id long, doc_id long")
    few = {(r.query_id, r.doc_id): r.score for r in search.bm25(docs, asked, most=2, also=also).collect()}
    ranked = lambda scores: {q: sorted((-round(s, 9), d) for (p, d), s in scores.items() if p == q)[:2] for q in (1, 2, 4)}
    assert ranked(few) == ranked(got) and (1, 5) in few and (2, 0) not in few and len(few) < len(got)
    monkeypatch.setattr(search, "MOST_WORDS", 0)
    joined = {(r.query_id, r.doc_id): r.score for r in search.bm25(docs, asked).collect()}
    assert joined.keys() == got.keys() and all(abs(joined[k] - got[k]) < 1e-9 for k in got)


def test_reference_self_join_meets_each_pair_once(spark, tmp_path):
    from lexmill.plans import catalogue

    lines = [(1, 5), (1, 5), (1, 7), (2, 7), (2, 5), (2, 9), (3, 1), (None, 4), (None, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["reference_self_join"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "<" in plan.split("Join Inner")[1].split("\n")[0]
    assert sorted(map(tuple, found.collect())) == [(5, 7), (5, 9), (7, 5), (7, 9), (9, 5), (9, 7)]
    assert found.columns == ["from_key", "to_key"]
