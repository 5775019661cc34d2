"""Readers of legal text, by examples."""

import pytest

from lexmill.functions import reading


def kinds(text):
    return [(p["penalty_type"], p["min_value"], p["max_value"], p["unit"]) for p in reading.penalties(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("يعاقب بالسجن مدة من ٣ إلى ٥ سنوات", [("سجن", 3, 5, "سنوات")]),
        ("السجن لمدة لا تقل عن 3 حتى 7 أعوام", [("سجن", 3, 7, "أعوام")]),
        ("سجناً 1-2 سنة", [("سجن", 1, 2, "سنة")]),
        ("بالسجن 5 سنوات", []),
        ("غرامة مالية لا تقل عن 1,000 جنيه ولا تزيد على 20,500 جنيه", [("غرامة", 1000, 20500, "جنيه")]),
        ("وبغرامة من 10 إلى 20", [("غرامة", 10, 20, "جنيه")]),
        ("بغرامة لا تقل عن 500 دولار.", [("غرامة", 500, None, "جنيه")]),
        ("بغرامة 500 جنيه", []),
        ("القتل العمد. الأشغال\n الشاقة", [("إعدام", None, None, None), ("أشغال_شاقة", None, None, None)]),
        ("من 1 إلى 2 سنوات", []),
        ("", []),
        ("السجن من 1 إلى 2 سنوات. السجن من 1 إلى 2 سنوات", [("سجن", 1, 2, "سنوات")]),
    ],
)
def test_penalties(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('يُقصد ب "المال": كل شيء. بعد', [("المال", "كل شيء")]),
        ("المقصود من الجهة، هيئة عامة", [("الجهة", "هيئة عامة")]),
        ("يعني السلاح: أداة\nتستعمل في القتل\nأو الجرح. ثم", [("السلاح", "أداة تستعمل في القتل أو الجرح")]),
        ("تعني كلمة: أول\n\nنص آخر.", [("كلمة", "أول")]),
        ("يُراد بدون علامة", []),
        ("يعني: .", []),
        ("يعني 'أ' : ب. ويعني 'ج' : د.", [("أ", "ب"), ("ج", "د")]),
    ],
)
def test_definitions(text, want):
    assert [(d["term"], d["definition_text"]) for d in reading.definitions(text)] == want


def test_articles_that_are_mentioned():
    assert reading.references("وفق المادة 5 مكرر (أ) والمادة (٧) و المواد 8 و 9، ومادة 5 مكررا (أ)") == ["5 مكرر (أ)", "٧", "8", "9", "5 مكررا (أ)"]
    assert reading.touched_articles("تضاف مادة 3 مكرر / ب والمادة 4 (ج) والمادة 3 مكرر / ب، المادة الأولى") == ["3 مكرر / ب", "4 (ج)"]
    assert reading.asked_article("ما نص المادة ( 12 مكرر أ ) في القانون") == "12 مكرر أ"
    assert reading.asked_article("المادة 12 في") == "12" and reading.asked_article("المادة الأولى") is None


def test_articles_and_tables():
    law = "ديباجة المادة 1: لا\n  مادة 1 : أ\nب\nالمادة (2 مكرر)- ج\nمادة ٣\n\nمادة 4. د\nالمادة 5"
    assert [(a["number"], a["body"]) for a in reading.articles(law)] == [(None, "ديباجة المادة 1: لا"), ("1", "أ\nب"), ("2 مكرر", "ج"), ("٣", "مادة 4. د\nالمادة 5")]
    assert reading.articles(" \n") == [] and reading.articles("نص") == [{"pos": 0, "number": None, "body": "نص"}]
    assert [(a["number"], a["body"]) for a in reading.tables("مقدمة جدول رقم (1)\na\nالجدول رقم ٢ b")] == [("1", "جدول رقم (1)\na"), ("٢", "الجدول رقم ٢ b")]
    assert reading.tables("x")[0]["number"] == "0" and reading.tables("") == []


def test_dates_and_heads():
    assert reading.gregorian("في 3 محرم الموافق الأحد 4 مايو سنة 2003") == "2003-05-04"
    assert reading.gregorian("الموافق يوليو 1952") == "1952-07-01" and reading.gregorian("الموافق غدا") is None
    assert reading.gregorian("الموافق س، ثم الموافق ٤ مايو ٢٠٠٣") == "2003-05-04"
    assert reading.law_and_years("القانون رقم 6 لسنة 2020 وقانون رقم ٧ لسنة ١٩٩٩، قانون رقم 3") == [{"a": 6, "b": 2020}, {"a": 7, "b": 1999}]
    head = reading.ruling("الطعن رقم 12 ، 13 لسنة ٨٠ ق\nجلسة 3 / 4 / 1999\nالدائرة الأولى، باسم الشعب")
    assert head == {"case_number": "12،13", "case_year": "٨٠", "ruling_date": "3 / 4 / 1999", "chamber": "الأولى"}
    assert set(reading.ruling("").values()) == {None}
    assert reading.first_article("تمهيد المادة الأولى: نص\nهنا المادة الثانية ينشر") == "نص\nهنا" and reading.first_article("x") is None


def test_long_and_odd_texts_are_read():
    assert kinds("كلمة " * 200_000 + "السجن من 1 إلى 2 سنة")[0][1:3] == (1, 2)
    for text in ("(", "مادة", "مادة (", "غرامة من", "السجن من 1 إلى", "يعني ", "جدول رقم", "الموافق", "\u0001\n\n", "المادة 5 و"):
        for read in (reading.penalties, reading.definitions, reading.references, reading.touched_articles, reading.asked_article, reading.articles, reading.tables, reading.law_and_years, reading.gregorian, reading.ruling, reading.first_article):
            read(text)
