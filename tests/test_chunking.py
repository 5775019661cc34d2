"""Articles, tables, windows, amendments, rulings, from literal rows and files."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking, extraction
from lexmill.sources import text_files

LAW = "ديباجة\nمادة 1: يعاقب بالسجن من 3 إلى 5 سنوات وبغرامة لا تقل عن 1,000 جنيه ولا تزيد على 5,000\nالمادة (2 مكرر) - القتل، انظر المادة 1 والمادة 9\nمادة ٣ -\n"


@pytest.fixture(scope="module")
def articles(spark):
    frame = spark.createDataFrame([("penal_code", LAW)], "law_id string, text string")
    return chunking.split_articles(frame).select("law_id", "article_number", "pos", F.col("page_content").alias("text")).cache()


def test_articles(articles):
    got = [(r.article_number, r.text[:6]) for r in articles.orderBy("pos").collect()]
    assert got == [(None, "ديباجة"), ("1", "يعاقب "), ("2 مكرر", "القتل،")]


def test_text_without_header_is_one_row(spark):
    frame = spark.createDataFrame([("a", "plain\ntext"), ("b", " ")], "law_id string, text string")
    assert [(r.law_id, r.article_number, r.page_content) for r in chunking.split_articles(frame).collect()] == [("a", None, "plain\ntext")]


def test_penalties(articles):
    got = {(r.article_number, r.penalty_type, r.min_value, r.max_value) for r in extraction.penalties(articles).collect()}
    assert got == {("1", "سجن", 3, 5), ("1", "غرامة", 1000, 5000), ("2 مكرر", "إعدام", None, None)}


def test_references_and_topics(articles):
    assert {(r.from_article, r.to_article) for r in extraction.references(articles).collect()} == {("2 مكرر", "1"), ("2 مكرر", "9")}
    assert [(r.article_number, r.topic_name) for r in extraction.topics(articles).collect()] == [("2 مكرر", "قتل")]


def test_tables_and_packing(spark):
    frame = spark.createDataFrame([("w", "جدول رقم (1)\na\n\nb\nجدول رقم ٢\nc"), ("x", "none")], "law_id string, text string")
    assert sorted((r.law_id, r.table_number) for r in chunking.split_tables(frame).collect()) == [("w", "1"), ("w", "2"), ("x", "0")]
    lines = spark.createDataFrame([("aa\n\nbb\ncccccc\nd",)], "t string")
    assert lines.select(chunking.pack_lines(F.col("t"), 5).alias("p")).first().p == ["aa\nbb", "cccccc", "d"]


@pytest.mark.parametrize(("size", "overlap"), [(5, 1), (3, 0), (40, 10)])
def test_recursive_split(size, overlap):
    text = "\n\n".join(" ".join(f"w{i}.{j}" for j in range(7)) for i in range(6))
    chunks = chunking.recursive_split(text, size, overlap)
    assert all(0 < len(c.split()) <= size for c in chunks)
    assert {c for w in text for c in w if c.isalnum()} <= set("".join(chunks))


def test_word_windows_cover(spark):
    row = spark.createDataFrame([(" ".join(map(str, range(10))), "")], "t string, e string").select(chunking.word_windows(F.col("t"), 4, 1).alias("w"), chunking.word_windows(F.col("e"), 4, 1).alias("e")).first()
    assert row.w == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"] and row.e == []


def test_amendments(spark):
    texts = [("new_x_num6_2020.txt", "تضاف مادة 5 مكرر"), ("new_x_5_2021.txt", "يلغى مادة 7"), ("new_x_2019_v3.txt", "مادة 1"), ("new_x.txt", "قانون رقم ١٢ لسنة ٢٠٠٣ الموافق الأحد 4 مايو سنة 2003 مادة 2"), ("new_y.txt", "مادة 3")]
    files = spark.createDataFrame([("penal_code", *t) for t in texts], "law_id string, name string, text string")
    got = {r.amendment_law_number: (r.amendment_date, r.amendment_type, r.amended_article_numbers) for r in extraction.amendments(files).collect()}
    assert got == {"6": ("2020-01-01", "addition", ["5 مكرر"]), "5": ("2021-01-01", "deletion", ["7"]), "3": ("2019-01-01", "modification", ["1"]), "12": ("2003-05-04", "modification", ["2"])}


def test_ruling_fields(spark):
    head = "دائرة الاثنين\nالطعن رقم ١٢٣ , 4 لسنة ٨٠ قضائية جلسة 5 مايو 2010"
    row = spark.createDataFrame([(head,)], "t string").select(*chunking.ruling_fields(F.col("t"))).first()
    assert tuple(row) == ("123,4", "80", "5 مايو 2010", "الاثنين")


def test_files(spark, tmp_path):
    laws = tmp_path / "laws"
    for folder in ("drugs", "unknown"):
        (laws / folder).mkdir(parents=True)
    (laws / "drugs" / "main.txt").write_text(LAW, encoding="utf-16")
    (laws / "drugs" / "my_tables.txt").write_text("جدول رقم 1\nx", encoding="cp1256")
    (laws / "drugs" / "new_num6_2020.txt").write_text("مادة 1: تضاف", encoding="utf-8")
    (laws / "drugs" / "New_other.txt").write_text("x")
    (laws / "drugs" / "blank.txt").write_text("  ")
    (laws / "unknown" / "main.txt").write_text("x")
    files = text_files.law_files(spark, str(laws))
    assert {(r.name, r.kind) for r in files.collect()} == {("main.txt", "main"), ("my_tables.txt", "tables"), ("new_num6_2020.txt", "amendment")}
    kinds = {(r.chunk_type, r.article_number, r.table_number, r.amendment_type) for r in chunking.law_chunks(files).collect()}
    assert kinds == {("preamble", None, None, None), ("article", "1", None, None), ("article", "2 مكرر", None, None), ("table", None, "1", None), ("amended_article", "1", None, "addition")}


def test_uploads(spark):
    files = spark.createDataFrame([("a.txt", 5), ("b.pdf", 5), ("c.txt", 0), ("d.txt", 21 << 20)], "name string, length long")
    assert [r.reason for r in text_files.validate_uploads(files).orderBy("name").collect()] == [None, "unsupported extension", "empty file", "file too large"]


def test_latest_versions(spark):
    chunks = spark.createDataFrame([("l", "1", "article", None, 0), ("l", "1", "amended_article", "2019", 1), ("l", "1", "amended_article", "2021", 2), ("l", "2", "article", None, 3), ("l", None, "preamble", None, 4)], "law_id string, article_number string, chunk_type string, amendment_date string, pos int")
    assert sorted(r.pos for r in chunking.latest_versions(chunks).collect()) == [2, 3, 4]
