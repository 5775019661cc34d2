"""Retrieval as a whole, graphs of rules and sections, stages as state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import articles as article_columns
from lexmill.operators import cases, chunking, extraction, graph, search


@pytest.fixture(scope="module")
def laws(spark):
    return spark.createDataFrame([("l1", "قانون العقوبات"), ("l2", "قانون الطوارئ")], "law_id string, law_title string")


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(f"a{i}", "l1" if i % 2 else "l2", str(i), f"نص المادة رقم {i} عن السرقة" if i < 6 else f"نص آخر {i}", [1.0, float(i)]) for i in range(12)]
    return spark.createDataFrame(rows, "id string, law_id string, article_number string, text string, embedding array<double>")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q1", "ما حكم السرقة في المادة 3 من قانون العقوبات", [1.0, 3.0]), ("q2", "حالة الطوارئ", [1.0, 0.0])], "query_id string, question string, query_embedding array<double>")


def test_law_of_a_question(questions, laws):
    got = {r.query_id: r.law_id for r in search.asked_law(questions, laws).collect()}
    assert got == {"q1": "l1", "q2": None}


def test_named_article_is_pinned(articles, questions, laws):
    got = search.retrieve(articles, questions, laws, k=5, threshold=0.1).collect()
    assert [(r.id, r.score) for r in got if r.pinned] == [("a3", 1.0)]
    assert not [r for r in got if r.query_id == "q1" and r.id == "a3" and not r.pinned]


def test_contexts_and_sources(spark, articles, questions, laws):
    chunks = spark.createDataFrame([(f"c{i}", f"t{i % 3}", f"سطر {i}", [1.0, float(i)], "l1", str(i % 3)) for i in range(9)], "id string, table_id string, text string, embedding array<double>, law_id string, table_number string")
    topics = articles.select("id", F.lit("سرقة").alias("name")).unionByName(articles.select("id", F.lit(None).cast("string").alias("name")))
    contexts, sources = search.answer_context(articles, chunks, questions, laws, {"topics": topics}, k=5, threshold=0.1, budget=600)
    text = {r.query_id: r.context for r in contexts.collect()}
    assert set(text) == {"q1", "q2"} and all(len(t) <= 600 for t in text.values())
    assert text["q1"].split("\n")[3].startswith("    المادة 3 |") and "    الموضوعات: سرقة\n" in text["q1"]
    kinds = [(r.query_id, r.type) for r in sources.collect()]
    assert kinds.count(("q1", "table")) == 3 and ("q1", "article") in kinds


def test_the_named_article_comes_first_and_weak_tables_stay_out(spark, articles, questions, laws):
    chunks = spark.createDataFrame([("near", "t1", "x", [1.0, 3.0], "l1", "1"), ("far", "t2", "y", [-1.0, -3.0], "l1", "2")], "id string, table_id string, text string, embedding array<double>, law_id string, table_number string")
    contexts, found = search.answer_context(articles, chunks, questions, laws, k=5, threshold=0.5)
    got = {r.query_id: r.context for r in contexts.collect()}
    assert got["q1"].startswith("\n\n[1] القانون: قانون العقوبات (ID: l1)\n    المادة 3 | درجة الصلة: 1.000\n")
    assert "[جدول 1] من l1" in got["q1"] and "جدول 2" not in got["q1"]
    assert [(r.article_number, r.score) for r in found.filter("type = 'table' AND query_id = 'q1'").collect()] == [("1", "1.000")]


@pytest.mark.parametrize("budget", [0, 3, 60, 90, 150, 200, 260, 400, 2000])
def test_budgets_of_articles_and_tables(spark, budget):
    """Against a plain loop: each side stops at its own first overflow, the tables' head must fit."""
    cases = [(["a" * 10, "b" * 80, "c"], ["\nt1\n", "\nlong" + "x" * 90 + "\n", "\nt3\n"]), ([], ["\nt\n"]), (["z" * 500], ["\nt\n"]), (["q"], [])]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, c struct<a: array<string>, t: array<string>>")
    got = {r.i: r.x for r in frame.select("i", search.filled(F.col("c.a"), F.col("c.t"), budget).alias("x")).collect()}
    for i, (blocks, tables) in enumerate(cases):
        text = ""
        for j, block in enumerate(blocks):
            piece = (search.RULE if j else "\n\n") + block + "\n"
            if len(text) + len(piece) > budget:
                break
            text += piece
        if tables and len(text) < budget:
            text += search.TABLES_HEAD if len(text) + len(search.TABLES_HEAD) <= budget else ""
            for block in tables:
                if len(text) + len(block) > budget:
                    break
                text += block
        assert got[i] == text


def test_what_a_block_shows(spark, articles, questions, laws):
    rows = {
        "amendments": spark.createDataFrame([("a3", i, f"200{i}", None if i else "addition", "7", "d" * 300) for i in (4, 0, 2, 1)], "id string, amendment_id int, date string, type string, law_number string, description string"),
        "penalties": spark.createDataFrame([("a3", "سجن", 1, None, "سنة"), ("a3", None, 2, 3, "سنة"), ("zz", "x", 1, 1, "y")], "id string, type string, min_value long, max_value long, unit string"),
        "definitions": spark.createDataFrame([("a3", f"t{i}", "m") for i in range(7)], "id string, term string, definition string"),
    }
    chunks = spark.createDataFrame([], "id string, table_id string, text string, embedding array<double>, law_id string, table_number string")
    contexts, _ = search.answer_context(articles, chunks, questions.filter("query_id = 'q1'"), laws, rows, k=1)
    block = contexts.first().context.split(search.RULE)[0]
    assert block.count("      • ") == 3 + 1 + 5 and "[addition] 2000 بموجب قانون 7: " + "d" * 200 + "\n" in block and "d" * 201 not in block
    assert "      • [?] 2001 بموجب قانون 7" in block and "2004" not in block and "      • سجن من 1 سنة\n" in block


def test_titles_by_containment(spark):
    """Against plain containment: prefixes, suffixes, one-letter names, names in names, marks and spaces."""
    names = ["الدستور", "قانون", "قانون العقوبات", "ق", "نظام  عام", "", None, "اب", "العقوبات"]
    laws = spark.createDataFrame([(f"l{i}", n) for i, n in enumerate(names)], "law_id string, law_title string")
    texts = ["والدستورية", "مادة من قانون العقوبات", "بالقانون", "نظام عام", "نِظام عام", "", None, "xاب", "عقوبات", "قانون الـعقوبات"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")
    plain = lambda x: " ".join("".join(c for c in x if not "\u0610" <= c <= "\u061a" and not "\u064b" <= c <= "\u065f").split())
    want = {i: max(((len(plain(n)), f"l{j}") for j, n in enumerate(names) if n and t is not None and plain(n) in plain(t)), default=(0, None))[1] for i, t in enumerate(texts)}
    assert {r.query_id: r.law_id for r in search.asked_law(asked, laws).collect()} == want
    assert search.asked_law(asked, laws.limit(0)).filter("law_id IS NOT NULL").count() == 0


def test_nearest_answers_all_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    x = np.random.default_rng(0).normal(size=(60, 5))
    x[5] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(4)
    got = search.nearest(frame, frame.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_embedding")), 4).collect()
    norm = np.linalg.norm(x, axis=1)
    cosine = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((60, 60)), where=np.outer(norm, norm) > 0)
    for i in range(60):
        own = sorted(((1 + cosine[i, j]) / 2, -j) for j in range(60))[-4:]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [-j for _, j in own[::-1]]


def test_principles_and_sparse_hits(spark, questions):
    chunks = spark.createDataFrame([(i, f"مبدأ السرقة {i}", [1.0, float(i)]) for i in range(3)], "doc_id long, text string, embedding array<double>")
    assert {r.query_id: r["count"] for r in search.retrieve_principles(chunks, questions, 9).groupBy("query_id").count().collect()} == {"q1": 3, "q2": 3}
    assert search.sparse_retrieve(chunks, questions, 2, {"doc_id": 1}).count() == 1
    with pytest.raises(ValueError):
        search.sparse_retrieve(chunks, questions, 2, {"doc_id": 77})


def test_what_a_context_shows(spark):
    frame = spark.createDataFrame([([("d" * 300, i) for i in range(5)], list(range(9)), "t" * 900)], "amendments array<struct<description:string,n:int>>, definitions array<int>, text string")
    (got,) = frame.select(*search.trimmed(F.col("amendments"), F.col("definitions"), F.col("text"))).collect()
    assert [len(a.description) for a in got.amendments] == [200] * 3 and len(got.definitions) == 5 and len(got.table_text) == 700


def test_texts_within_a_budget_in_any_partitioning(spark):
    rows = [(f"s{i % 2}", i, "x" * (i % 50)) for i in range(500)]
    used, want = {"s0": -2, "s1": -2}, []
    for source, i, text in rows:
        used[source] += len(text) + 3
        if used[source] <= 900:
            want.append((source, i, used[source]))
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "source string, doc_id int, text string").repartition(parts)
        assert sorted(tuple(r) for r in search.first_blocks(frame, "source", "doc_id", "text", 900).collect()) == sorted(want)


def test_rules_of_sentences_make_a_graph(spark):
    frame = spark.createDataFrame([("a1", "يعاقب على السرقة بالحبس 3 سنوات. نص عام."), ("a2", "لا شيء هنا")], "article_id string, text string")
    rules = extraction.sentence_rules(frame)
    got = {r.article_id: r for r in rules.collect()}
    assert got["a1"].penalty.type == "حبس" and got["a1"].penalty.max_value == 3 and "سرقة" in got["a1"].concepts
    assert got["a2"].rule_text == "لا شيء هنا" and got["a2"].concepts == [] and got["a2"].penalty.type is None
    nodes, edges = graph.rule_graph(rules)
    assert nodes["LegalRule"].count() == 2 and '"type":"حبس"' in [r.penalty for r in nodes["LegalRule"].collect() if "السرقة" in r.text][0]
    assert {r.rel for r in edges.collect()} == {"CONTAINS_RULE", "RELATES_TO"}


def test_sections_and_exceptions(spark):
    articles = spark.createDataFrame([("a1", "l", "s1"), ("a2", "l", None)], "id string, law_id string, section_id string")
    sections = spark.createDataFrame([("l", "s1", "first", 1), ("l", "s1", "again", 2)], "law_id string, section_id string, title string, pos int")
    exceptions = spark.createDataFrame([("a1", "but"), ("a1", "but")], "article_id string, text string")
    concepts = spark.createDataFrame([("a1", " theft "), ("a2", "theft"), ("a2", " ")], "article_id string, name string")
    nodes, edges = graph.section_graph(articles, sections, exceptions, concepts)
    assert [r.title for r in nodes["Section"].collect()] == ["first"] and nodes["Exception"].count() == 1 and nodes["Concept"].count() == 1
    assert {r.rel: r["count"] for r in edges.groupBy("rel").count().collect()} == {"HAS_SECTION": 1, "HAS_ARTICLE": 1, "HAS_EXCEPTION": 1, "MENTIONS": 2}


def test_a_stage_that_fails_while_it_runs_is_state(spark, tmp_path):
    @F.udf("int")
    def broken(x):
        raise RuntimeError("no answer")

    rows = spark.createDataFrame([(1,), (2,)], "case_id long")
    got = cases.run_stages(rows, [("good", lambda c: c), ("bad", lambda c: c.withColumn("x", broken("case_id")).filter("x = 1"))], str(tmp_path)).collect()
    state = {r.agent: r.status for r in got}
    assert state["good"] == "done" and state["bad"] != "done" and len(got) == 4


def test_ordinals_breaks_and_patterns(spark):
    frame = spark.createDataFrame([("مادة أولاً", "a\u0001\nالمادة 1: x")], "law_id string, t string").withColumn("n", F.col("law_id"))
    assert frame.select(article_columns.ordinal_token(F.col("n")).alias("x")).first().x.endswith("أولا")
    assert [r.page_content for r in chunking.split_articles(frame, "t").orderBy("pos").collect()] == ["a\u0001", "x"]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abc", ["abc"]), ("ab*c", ["a"]), ("ab+c", ["ab"]), ("a|bc", ["a", "bc"]), ("(ab|c)de", ["de"]), (r"x\.y", ["x.y"]), (r"\d+", None), ("a|.*", None), ("(?U)word", ["word"]), ("(?i)word", None), ("[abc]def{2}", ["de"]), ("^x$", ["x"]), ("a(?!b)", None), ("[]x]y", ["y"]), ("", None), (r"\Qa.b\E", None), ("colou?r", ["colo"])],
)
def test_words_that_a_pattern_needs(pattern, want):
    assert extraction.required_literals(pattern) == want


def test_patterns_find_what_plain_matching_finds(spark, monkeypatch):
    import re

    monkeypatch.setattr(extraction, "PATTERN_BLOCK", 2)
    texts = ["the theft of 3 cars", "a colour", "color x.y", "", None, "no 12 34", "theft"]
    patterns = [("a", "theft"), ("b", "colou?r"), ("c", r"x\.y|cars"), ("d", r"\d+ \d+"), ("e", "^$"), ("f", "[xyz]"), ("a", "cars"), ("g", "nothing here"), ("h", "th|co")]
    articles = spark.createDataFrame([("l", str(i), t) for i, t in enumerate(texts)], "law_id string, article_number string, text string")
    got = {(r.article_number, r.topic_name) for r in extraction.topics_by_patterns(articles, spark.createDataFrame(patterns, "topic_name string, pattern string")).collect()}
    assert got == {(str(i), n) for i, t in enumerate(texts) if t is not None for n, p in patterns if re.search(p, t)}
    assert extraction.topics_by_patterns(articles, spark.createDataFrame([], "topic_name string, pattern string")).count() == 0


def test_heads_within_reach(spark):
    text = "قانون رقم 5 لسنة 1999\nالباب الأول\nمادة 1: a\n" + "x" * 600 + "\nمادة (٢) b\nالفصل 3 المادة الثالث c"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "no article"), (4, "الباب الثاني " + "y" * 500 + " مادة 9: z")], "doc_id int, text string")
    got = [tuple(r)[:-1] for r in chunking.articles_in_context(frame).orderBy("doc_id", "at").collect()]
    assert [(g[0], *g[2:]) for g in got] == [(1, "1", "قانون رقم 5 لسنة 1999", "الباب الأول", None), (1, "2", "قانون رقم 5 لسنة 1999", "الباب الأول", None), (1, None, "قانون رقم 5 لسنة 1999", "الباب الأول", "الفصل 3"), (4, "9", None, None, None)]
    short = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id int, text string")
    assert sorted((r.doc_id, r.page_content, r.chunk_index) for r in chunking.document_index(short).collect() if r.doc_id) == [(1, None, None), (2, "", None), (3, "x", None)]


def test_of_equal_edges_the_last_stays(spark):
    rows = [("a", "b", 3, "2001"), ("a", "b", 9, "2000"), ("a", "b", 5, "2001"), ("a", "c", None, None)]
    frame = spark.createDataFrame(rows, "s string, d string, p int, t string")
    for parts in (1, 4):
        got = graph.edge("R", frame.repartition(parts), "s", "d", position=F.col("p"), amendment_date=F.col("t")).collect()
        assert sorted((r.src_id, r.dst_id, r.position, r.amendment_date) for r in got) == [("a", "b", 5, "2001"), ("a", "c", None, None)]
