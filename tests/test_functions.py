"""Arabic text, article numbers and loosely typed fields."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import arabic, articles, coerce


def one(spark, column, *values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_digits(spark):
    assert one(spark, arabic.western_digits, "٠١٢٣٤٥٦٧٨٩", None) == ["0123456789", None]
    assert one(spark, lambda c: arabic.western_digits(c, eastern=True), "۱٢3") == ["123"]


def test_normalisation(spark):
    assert one(spark, arabic.normalize_for_topics, "الأَسْلِحةُ  ىئؤ", "") == ["الاسلحه ييو", ""]
    assert one(spark, arabic.normalize_for_search, "مَادّة\n ١") == ["مادة ١"]
    assert one(spark, arabic.clean_text, "a‏ b  c ﬁ") == ["a b c fi"]


def test_tokens_keep_arabic(spark):
    assert one(spark, arabic.tokens, "المادة (٢٣٦)، من-قانون a_b!", "", None) == [["المادة", "٢٣٦", "من", "قانون", "a_b"], [], None]


def test_stable_id_reads_null_as_none(spark):
    import hashlib

    assert one(spark, lambda c: arabic.stable_id(F.lit("penal_code"), c, F.lit(3)), "86", None) == [hashlib.sha256(f"penal_code|{v}|3".encode()).hexdigest()[:16] for v in ("86", "None")]


@pytest.mark.parametrize(
    ("given", "standard"),
    [("٧٨أ", "78 (أ)"), ("86 مكرراً", "86 مكرر"), ("86مكرر(أ)", "86 مكرر (أ)"), ("86 مكرر ا", "86 مكرر (أ)"), ("1 ف (2)", "1 ف(2)"), ("1 / 7", "1/7"), ("", None), (None, None)],
)
def test_article_numbers(spark, given, standard):
    assert one(spark, articles.normalize_article, given) == [standard]


def test_article_schema_form(spark):
    assert one(spark, lambda c: articles.normalize_article(c, schema_form=True), "«".strip("«") + " ۱۲، ", "1 ف 2", "‏5") == ["12", "1 ف(2)", "5"]


def test_variants_start_with_the_standard_form(spark):
    (found,) = one(spark, articles.article_variants, "78(أ)")
    assert found[0] == "78 (أ)" and "78/أ" in found and len(set(found)) == len(found)
    assert one(spark, articles.article_variants, None) == [[]]


def test_valid_articles(spark):
    assert one(spark, articles.valid_article, "86 مكرر (أ)", "12", "86bis") == [True, True, False]


def test_coercions(spark):
    assert one(spark, coerce.age, "نحو 30 سنة", "٤٥", "x", None) == [30, 45, None, None]
    assert one(spark, coerce.bool_required, "نعم", "no", None) == [True, False, False]
    assert one(spark, coerce.bool_optional, " Yes ", "لا", "?", None) == [True, False, None, None]
    assert one(spark, coerce.law_code, "anti_drugs", "وفقا لقانون العقوبات", "?") == ["anti_drugs", "penal_code", None]
    assert one(spark, coerce.route, "Amr-Ihala 1", "x", None) == ["amr_ihala", None, None]
    assert one(spark, coerce.date_or_range, '{"start": "2020-01-01", "end": "2020-02-01"}', "2020-01-01", '{"start": "2020-01-01"}') == ["2020-01-01 إلى 2020-02-01", "2020-01-01", "2020-01-01"]
    assert one(spark, coerce.placeholder_to_null, "-----", " . ", "a-b") == [None, None, "a-b"]
    assert one(spark, coerce.string_list, '["a", {"k": "b"}, " "]', '"c"', None, "loose") == [["a", "b"], ["c"], [], ["loose"]]
    assert one(spark, coerce.retry_after, "429: retry-after: 12.5 s", "no") == [12.5, None]


def test_salvaged_json(spark):
    given = ['```json\n{"a": 1}\n```', 'so: {"a": 1} ok', '"{\\"a\\": 1}"', "[1]", "none"]
    assert one(spark, coerce.salvage_json, *given) == ['{"a": 1}', '{"a": 1}', '{"a": 1}', "[1]", None]
