"""What went wrong on larger or odder inputs than those of the other tests."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import reading
from lexmill.operators import chunking, extraction, graph, lexical_index, search


def test_a_context_ends_at_its_first_long_text_in_whatever_task_that_is(spark):
    sizes = [40, 70, 5, 5]
    rows = [("g", i, "x" * n) for i, n in enumerate(sizes)] + [("n", 0, None), ("n", 1, "x" * 97), ("n", 2, "x"), ("o", 0, "x" * 99)]
    docs = spark.createDataFrame(rows, "g string, i long, t string").repartitionByRange(2, "i")  # 0 and 1, 2 and 3 in one task
    found = sorted(map(tuple, search.first_blocks(docs, "g", "i", "t", 100).collect()))
    assert found == [("g", 0, 41), ("n", 1, 100), ("o", 0, 100)]


def test_pieces_lose_white_space_at_their_ends_and_nothing_else(spark):
    long = "word " * 12
    text = f"{long}. 0{long}.  {long}2. 3{long}3. 4444 "
    kept = [f"{long}.", f"0{long}.", f"{long}2.", f"3{long}3. 4444"]
    found = spark.createDataFrame([(text,)], "t string").select(chunking.merge_short_sentences(F.col("t")).alias("p")).first().p
    assert found == kept
    articles = spark.createDataFrame([(1, "سرقة 0 ثم 0. 1 سرقة 1")], "article_id int, text string")
    assert sorted(r.rule_text for r in extraction.sentence_rules(articles).collect()) == ["1 سرقة 1", "سرقة 0 ثم 0."]


def test_scores_of_sources_are_printed_from_their_exact_value(spark):
    scores = [(k * 1000 + 500) / 1_000_000 for k in range(1000)]
    rows = spark.createDataFrame([(i, "law", "1", "t", "", s) for i, s in enumerate(scores)], "query_id int, law_id string, article_number string, law_title string, text string, score double")
    found = {r.query_id: r.score for r in search.sources(rows, rows.limit(0)).collect()}
    assert found == {i: f"{s:.3f}" for i, s in enumerate(scores)}


class _Held:
    def __init__(self, value):
        self.value = value


def test_a_task_of_a_search_keeps_little_however_large_its_batches_are(monkeypatch):
    rnd = np.random.default_rng(3)
    q, x = rnd.normal(size=(300, 8)), rnd.normal(size=(20_000, 8))
    x[5000:9000] = q[0]  # copies
    x[9000:9500] = q[1] * (1 + rnd.random((500, 1)))
    vectors = pa.array(list(x))
    batch = pa.record_batch([pa.array(np.arange(20_000)[::-1].copy()), vectors], names=["key", "embedding"])
    taken, nonzero = [], np.nonzero
    monkeypatch.setattr(search.np, "nonzero", lambda a: taken.append(int(a.sum())) or nonzero(a))
    for measure in ("cosine", "l2"):
        (found,) = search._best_of_task(_Held(q), 5, measure, 6)(iter([batch]))
        assert found.num_rows < 300 * 5 * 4
        got = {}
        for place, key, score in zip(*[c.to_pylist() for c in found.columns]):
            got.setdefault(place, []).append((round(-score if measure == "cosine" else score, 6), key))
        cosine = (1 + q @ x.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))) / 2
        whole = -cosine if measure == "cosine" else np.stack([((x - row) ** 2).sum(axis=1) for row in q])
        for i in (0, 1, 2, 299):
            want = sorted((round(s, 6), 19_999 - k) for k, s in enumerate(whole[i]))[:5]
            assert sorted(got[i])[:5] == want
    assert max(taken) <= 256 * 1024


def test_laws_of_one_title_do_not_multiply_the_questions_that_name_it(spark, monkeypatch):
    laws = spark.range(400).select(F.format_string("l%03d", "id").alias("law_id"), F.when(F.col("id") < 300, "نظام").otherwise(F.concat(F.lit("قانون "), "id")).alias("law_title"))
    questions = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("ما النظام في قانون "), F.col("id") + 340, F.lit("0")).alias("question"))
    rows, contained = [], search.contained

    def counted(*args):
        found = contained(*args)
        rows.append(found.count())
        return found

    monkeypatch.setattr(search, "contained", counted)
    for most in (search.MOST_RUNS, 10):
        monkeypatch.setattr(search, "MOST_RUNS", most)
        found = {r.query_id: r.law_id for r in search.asked_law(questions, laws).collect()}
        assert found == {i: f"l{i + 340}" for i in range(50)}
    assert rows == [100, 100]


def test_articles_of_a_long_law_are_read_without_all_its_tokens():
    law = "قانون عام\n" + "\n".join(f"المادة {i}: " + "نص " * 200 for i in range(1500))
    tracemalloc.start()
    found = reading.articles(law)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1501 and found[-1] == {"pos": 1500, "number": "1499", "body": ("نص " * 200).strip()}
    assert peak < 4 * 2 * len(law)  # the text has two bytes a character
    odd = "مادة 1\n\n  المادة (2) : ب\nنص مادة 3: لا\nالمادةة 4: لا\n مادة\n5 مكرر (أ) - ج\nمادة 6x\nمادة"
    assert [(a["number"], a["body"]) for a in reading.articles(odd)] == [("2", "ب\nنص مادة 3: لا\nالمادةة 4: لا"), ("5 مكرر (أ)", "ج\nمادة 6x\nمادة")]


def test_texts_go_to_a_reader_once_and_only_where_it_may_find_something(spark):
    files = spark.createDataFrame([("l", "x_1_2000.txt", "المادة 3 الموافق 5 مايو سنة 1999. المادة الأولى: وصف")], "law_id string, name string, text string")
    found = extraction.amendments(files)
    evaluated = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ")
    assert evaluated(found) == 1
    row = found.first()
    assert (row.amendment_date, row.effective_date, row.amended_article_numbers, row.description) == ("1999-05-05", "1999-05-05", ["3"], "وصف")
    rows = [("l", "1", "السجن مدة من 1 إلى 3 سنوات"), ("l", "2", "نص"), ("l", "3", None), ("l", "4", 'يعني "ب": ج. مادة 1')]
    articles = spark.createDataFrame(rows, "law_id string, article_number string, text string")
    assert [r.article_number for r in extraction.with_any(articles, reading.PENALTY_MARKS).collect()] == ["1"]
    assert [r.min_value for r in extraction.penalties(articles).collect()] == [1]
    assert [r.to_article for r in extraction.references(articles).collect()] == ["1"]
    assert [r.term for r in extraction.definitions(articles).collect()] == ["ب"]


def test_facts_that_nodes_and_edges_read_can_be_kept(spark):
    articles = graph.article_nodes(spark.createDataFrame([("l", "1", 1, "السجن مدة من 1 إلى 3 سنوات. جريمة سرقة"), ("l", "2", 2, 'يعني "ب": ج. مادة 1')], "law_id string, article_number string, pos int, text string"))
    found = [extraction.penalties(articles), extraction.definitions(articles), extraction.references(articles), extraction.topics(articles)]
    kept = []
    nodes, edges = graph.build_facts(articles, *found, keep=lambda facts: kept.append(facts) or spark.createDataFrame(facts.collect(), facts.schema))
    assert kept == [found[0], found[1], found[3]]
    counted = lambda n, e: sorted(map(tuple, graph.statistics(n, e, spark).collect()))
    assert counted(nodes, edges) == counted(*graph.build_facts(articles, *found))


def test_few_patterns_join_no_texts(spark):
    rows = [("l", "1", "سرقة 12 يوم."), ("l", "2", "سلاح"), ("l", "2", "سلاح"), ("l", "3", None), (None, "4", "x سرقة")]
    articles = spark.createDataFrame(rows, "law_id string, article_number string, text string")
    patterns = spark.createDataFrame([("theft", "سرقة"), ("either", "سلاح|سرقة"), ("days", "[0-9]+"), ("none", None)], "topic_name string, pattern string")
    found = extraction.topics_by_patterns(articles, patterns)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("l", "1", "days"), ("l", "1", "either"), ("l", "1", "theft"), ("l", "2", "either"), (None, "4", "either"), (None, "4", "theft")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert extraction.topics_by_patterns(articles, patterns.limit(0)).count() == 0


def test_topic_makes_the_bare_text_once(spark):
    texts = spark.createDataFrame([("قَتَلَ قاتل",), ("مُخدّرات وسلاح",), ("لا شيء",), (None,)], "text string")
    found = texts.select(extraction.topic(F.col("text")).alias("t"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [r.t for r in found.collect()] == ["قتل", "مخدرات", None, None]


def test_outlines_go_to_arrow_before_the_next_texts_are_read(spark):
    assert reading._AT_ONCE <= 1 << 16
    texts = ["المادة 1: أ" * 2 + "\n", None, "", "الباب 3\nالمادة 5: ب " + "كلمة " * 20_000, "الفصل 2"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(reading.read_outline(F.col("t")).alias("o")).collect()
    want = [None if t is None else [(h["kind"], h["at"], h["value"], h["body"]) for h in reading.outline(t)] for t in texts]
    assert [None if r.o is None else [tuple(h) for h in r.o] for r in found] == want


def test_amendments_are_ordered_within_their_article_and_applied_once(spark):
    rnd = random.Random(8)
    pick = lambda *values: rnd.choice(values)
    originals = [(pick("l", "m", None), pick("1", "2", None), k) for k in range(5)] + [("l", "1", 9), ("l", "1", 10)]
    articles = graph.article_nodes(spark.createDataFrame([(*o, "t") for o in originals], "law_id string, article_number string, pos int, text string"))
    rows = [(f"a{k:02d}", pick("l", "m", None), pick("1", "2", None), pick("2001-01-01", "2002-01-01", None), pick("addition", "modification", "deletion", None), rnd.choices(["1", "2", "3", "4", None], k=rnd.randint(0, 4)), f"d{k}") for k in range(60)]
    amendments = spark.createDataFrame(rows, "amendment_id string, law_id string, amendment_law_number string, amendment_date string, amendment_type string, amended_article_numbers array<string>, description string")
    kept = []
    versions, edges = graph.apply_amendments(articles, amendments, keep=lambda changes: kept.append(changes) or spark.createDataFrame(changes.collect(), changes.schema))
    windows = re.findall(r"\], \[(law_id#\d+[^\]]*)\], \[turn|\], \[(law_id#\d+[^\]]*)\], \[amendment_law", kept[0]._jdf.queryExecution().executedPlan().toString())
    assert len(kept) == 1 and windows and all("article_number#" in (a or b) for a, b in windows)

    # one amendment after the other
    old = {}
    for r in articles.collect():
        old.setdefault((r.law_id, r.article_number), {})[r.id] = ("original", None, r.text)
    want, last = set(), lambda x: (x is not None, x or "")
    for number, law, law_number, date, kind, numbers, text in sorted(rows, key=lambda r: (last(r[3]), last(r[2]), r[0])):
        for article in dict.fromkeys(numbers):
            own = old.setdefault((law, article), {})
            before = {} if law is None or article is None else dict(own)
            want |= {("AMENDED_BY", i, number) for i in before}
            tag = {"addition": "added", "modification": "amended"}.get(kind)
            there = any(t == "added" for t, _, _ in own.values()) or any(t == "original" for t, _, _ in before.values())
            if tag == "added" or (tag and there):
                new = hashlib.sha256("|".join(str(x) for x in (law, article, tag, date)).encode()).hexdigest()[:16]
                want |= {("SUPERSEDES", new, i) for i, (t, _, _) in before.items() if i != new and t != "amended" and (tag == "amended" or t == "original")}
                want |= {("AMENDED_BY", new, number)} if tag == "added" else set()
                own.setdefault(new, (tag, date, text))
        want.add(("HAS_AMENDMENT", law, number))
    assert {(e.rel, e.src_id, e.dst_id) for e in edges.collect()} == want and edges.count() == len(want)
    made = sorted(((r.law_id, r.article_number, r.id, r.version, r.text, r.is_addition, r.is_amended) for r in versions.filter("is_addition OR is_amended").collect()), key=str)
    assert made == sorted(((*at, i, date, text, tag == "added", tag == "amended") for at, own in old.items() for i, (tag, date, text) in own.items() if tag != "original"), key=str)
    plain = graph.apply_amendments(articles, amendments)
    assert sorted(map(tuple, plain[1].collect()), key=str) == sorted(map(tuple, edges.collect()), key=str)


def test_an_index_of_texts_takes_less_disk_than_they_do(spark, tmp_path):
    rnd = random.Random(11)
    words = [f"{rnd.getrandbits(40):x}" for _ in range(3000)]
    texts = [" ".join(words[int(3000 * rnd.random() ** 3)] for _ in range(150)) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    whole, status = sum(map(len, texts)), spark._jsc.sc().statusStore()
    stages = lambda: spark._jsc.sc().dagScheduler().nextStageId()

    def written():
        total = 0
        for i in range(begun, stages()):
            try:
                total += status.lastStageAttempt(i).shuffleWriteBytes()
            except Exception:  # noqa: BLE001 - a skipped stage has no attempt
                continue
        return total

    docs.write.parquet(f"{tmp_path}/docs")
    begun = stages()
    lexical_index.write_lexical_index(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index")
    stored = sum(f.stat().st_size for f in tmp_path.joinpath("index").rglob("*.parquet"))
    assert stored + written() < whole
    begun = stages()
    questions = spark.createDataFrame([(i, " ".join(rnd.choices(words[:50], k=8))) for i in range(40)], "query_id int, question string")
    found, _ = lexical_index.search_lexical_index(spark, f"{tmp_path}/index", questions, 5)
    assert found.count() == 200 and written() < whole


def test_articles_of_a_text_in_parts_are_those_of_the_whole(spark):
    rnd = random.Random(5)
    lines = ["المادة 1: أ", " مادة (2 مكرر) - ب", "المادة 3:", "نص", "\t", "", "المادة 4\u00a0نص\u2003", "مادة 5", "النص مادة 6: لا", "المادة ٧ : \x1cج\x1f"]
    laws = {f"l{i}": [[rnd.choice(lines) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 9))] for i in range(60)}
    laws |= {"blank": [[""], [" "]], "none": [["نص"], [""], ["نص"]], None: [["نص", "مادة 1: أ"], ["ب"], ["مادة 2: ج"]]}
    rows = [(law, p * 10 - 20, "\n".join(part)) for law, parts in laws.items() for p, part in enumerate(parts)]
    rnd.shuffle(rows)
    parts = spark.createDataFrame([*rows, ("l0", 1000, None)], "law_id string, part long, text string")
    found = sorted(map(tuple, chunking.split_articles_of_parts(parts, "law_id").collect()), key=str)
    whole = spark.createDataFrame([(law, "".join("\n".join(p) + "\n" for p in parts)) for law, parts in laws.items()], "law_id string, text string")
    want = chunking.split_articles(whole).select("law_id", "pos", "article_number", "page_content")
    assert found == sorted(map(tuple, want.collect()), key=str) and len(found) > 300


def test_no_row_holds_a_whole_law(spark, tmp_path, monkeypatch):
    from lexmill.plans import legal

    keys = "SELECT id AS o_orderkey, id % 10 AS o_custkey FROM range(100000)"
    spark.sql(keys).write.parquet(f"{tmp_path}/orders.parquet")
    longest = []
    split = lambda parts, key: longest.append(parts.agg(F.max(F.length("text")), F.sum(F.length("text"))).first()) or parts.select(key, F.lit(0).alias("pos"), F.lit("").alias("article_number"), F.lit("").alias("page_content"))
    for name in ("split_articles", "split_articles_of_parts"):
        monkeypatch.setattr(chunking, name, lambda parts, key="law_id": split(parts, key))
    legal.articles_of_law_texts(spark, str(tmp_path)).count()
    (most, whole), = longest
    assert whole > 5_000_000 and most < 50_000
