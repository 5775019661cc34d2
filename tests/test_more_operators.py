"""History, schedules, versions, windows and shapes of answers."""

from pyspark.sql import functions as F

from lexmill.functions import coerce
from lexmill.operators import cases, chunking, extraction, graph


def test_windows_and_sections(spark):
    row = spark.createDataFrame([("abcdefghij", "الوقائع: x y الحكم: z")], "t string, s string").select(chunking.char_windows(F.col("t"), 4, 1).alias("w"), *chunking.sections(F.col("s"), {"facts": "الوقائع", "ruling": "الحكم"})).first()
    assert row.w == ["abcd", "defg", "ghij", "j"] and (row.facts, row.ruling) == ("x y", "z")
    parts = chunking.ruling_parts(spark.createDataFrame([(1, " ".join("abcdefg")), (2, "short")], "id int, text string"), "id", "text", 4, 1).orderBy("id", "sub_index").collect()
    assert [(r.id, r.sub_index, r.chunk_total, r.word_count) for r in parts] == [(1, 0, 3, 4), (1, 1, 3, 4), (1, 2, 3, 1), (2, 0, 1, 1)]


def test_history_and_links(spark):
    kinds = "id string, law_id string, article_number string, version string"
    articles = spark.createDataFrame([("o", "l", "1", None), ("v", "l", "1", "2020"), ("x", "l", "2", None)], kinds)
    edges = spark.createDataFrame([("SUPERSEDES", "v", "o"), ("AMENDED_BY", "o", "m"), ("REFERENCES", "x", "o"), ("TAGGED_WITH", "x", "t")], "rel string, src_id string, dst_id string")
    got = [(r.id, r.amendments, r.supersedes, r.superseded_by) for r in graph.article_history(articles, edges, "l", "1").collect()]
    assert got == [("o", ["m"], [], ["v"]), ("v", [], ["o"], [])]
    assert [r.id for r in graph.linked_articles(edges, articles, "TAGGED_WITH", spark.createDataFrame([("t",)], "id string")).collect()] == ["x"]
    assert {r.id: [x.article_number for x in r.referenced] for r in graph.with_references(articles, edges).collect()} == {"o": [], "v": [], "x": ["1"]}
    nodes = spark.createDataFrame([("o", "Article"), ("t", "Topic"), ("x", "Article")], "id string, label string")
    kept, between = graph.allowed(nodes, edges, ["Article"], ["REFERENCES", "TAGGED_WITH"])
    assert kept.count() == 2 and [(e.src_id, e.dst_id) for e in between.collect()] == [("x", "o")]


def test_schedules(spark):
    tables = spark.createDataFrame([("anti_drugs", "1", "١- أفيون Opium\nheader\n2. كوكايين (Cocaine)")], "law_id string, table_number string, text string")
    entries = extraction.schedule_entries(tables)
    assert sorted((r.entry_number, r.name, r.latin_name) for r in entries.collect()) == [(1, "أفيون", "Opium"), (2, "كوكايين", "Cocaine")]
    nodes, edges = graph.schedule_graph(entries)
    assert nodes["Substance"].count() == 2 and edges.groupBy("rel").count().count() == 3


def test_versions_to_index(spark):
    chunks = spark.createDataFrame([("l", "1", "article", None, 0), ("l", "1", "amended_article", "2021", 1)], "law_id string, article_number string, chunk_type string, amendment_date string, pos int")
    assert {m: [r.pos for r in chunking.of_version(chunks, m).orderBy("pos").collect()] for m in ("all", "latest", "original", "amended")} == {"all": [0, 1], "latest": [1], "original": [0], "amended": [1]}


def test_shapes_of_answers(spark):
    given = [(0, '{"name": "أحمد", "role": "ضابط"}'), (1, '["a", "b"]'), (2, " x "), (3, None)]
    rows = spark.createDataFrame(given, "i int, j string").orderBy("i").select(coerce.name_with_title(F.col("j")).alias("n")).collect()
    assert [r.n for r in rows] == ["أحمد - ضابط", "a، b", "x", None]
    one = spark.createDataFrame([('{"description": "d"}', '[{"question": "q", "answer": "a"}]')], "f string, s string").select(coerce.factor(F.col("f")).alias("f"), coerce.statement_summary(F.col("s")).alias("s")).first()
    assert one.f == "d" and one.s == "س: q\nج: a"
    asked = spark.createDataFrame([(1, "q", '{"article_query": "a"}'), (2, "q", "?")], "query_id int, question string, answer string")
    assert [(r.article_query, r.principle_query) for r in cases.transformed_queries(asked).orderBy("query_id").collect()] == [("a", "q"), ("q", "q")]
    scores = spark.createDataFrame([(1, '{"incidents": [{"evidences": [{"evidence_id": "e1", "strength": "STRONG"}]}, {"evidences": [{"evidence_id": "e2"}]}]}')], "case_id int, answer string")
    assert sorted(r.evidence_id for r in cases.evidence_scores(scores).collect()) == ["e1", "e2"]
    assert cases.sanitised([{"role": "x", "content": " a "}, {"role": "system", "content": ""}]) == [{"role": "user", "content": "a"}]
