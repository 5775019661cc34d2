"""Column functions for article numbers such as "86 bis (a)"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arabic import collapse, western_digits
from .vocabulary import BIS

_ALEF = "[أإآا]"


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)


def article_token(text: Column) -> Column:
    """Western digits, single spaces, one spelling of "bis"."""
    return F.trim(F.regexp_replace(collapse(western_digits(text)), rf"{BIS}[اأإآى\u064b-\u0652]?", BIS))


def ordinal_token(text: Column) -> Column:
    """article_token with one spelling of "firstly" and "secondly"."""
    return F.regexp_replace(article_token(text), "(أولا|ثانيا)ً", "$1")


def _spaced(text: Column) -> Column:
    return collapse(_apply(collapse(text), [(r"\s*/\s*", "/"), (r"\s*\(\s*", " ("), (r"\s*\)\s*", ")")]))


def normalize_article(text: Column, schema_form: bool = False) -> Column:
    """The standard form of an article number; null and blank give null.

    schema_form, for fields of extracted entities, also reads Eastern digits, drops direction marks and outer
    punctuation, and gives clauses without brackets theirs.
    """
    bis = _apply(western_digits(F.trim(text), eastern=schema_form), [(f"{BIS}(?:اً|ا|ة)", BIS), ("ـ", "")])
    if schema_form:
        bis = F.regexp_replace(bis, r"[\u200e\u200f]", "")
    spaced = _spaced(bis)
    if schema_form:
        spaced = F.regexp_replace(spaced, r"""^["'،,.;: ]+|["'،,.;: ]+$""", "")
    steps = [
        (rf"^(\d+)\s*({_ALEF})$", "$1 (أ)"),
        (r"^(\d+)\(([^)]+)\)$", "$1 ($2)"),
        (rf"^(\d+)\s*{BIS}\s*\(([^)]+)\)$", f"$1 {BIS} ($2)"),
        (rf"^(\d+)\s*{BIS}\s*{_ALEF}$", f"$1 {BIS} (أ)"),
        (r"^(\d+)\s*ف\s*\(\s*(\d+)\s*\)$", "$1 ف($2)"),
    ]
    if schema_form:
        steps.append((r"^(\d+)\s*ف\s+(\d+)$", "$1 ف($2)"))
    return F.nullif(_apply(spaced, steps), F.lit(""))


def article_variants(text: Column) -> Column:
    """The distinct forms under which an article may be stored, the standard one first; of null an empty array."""
    base = normalize_article(text)

    def forms(pattern: str, *templates: str) -> list[Column]:
        return [F.when(base.rlike(pattern), F.regexp_replace(base, pattern, t)) for t in templates]

    listed = [
        base,
        F.regexp_replace(base, "/", " / "),
        *forms(r"^(\d+)\s*\(([^)]+)\)$", "$1$2", "$1/$2", "$1 $2"),
        *forms(rf"^(\d+)\s*{BIS}\s*\(([^)]+)\)$", f"$1 {BIS}($2)", f"$1 {BIS} $2", f"$1 {BIS}/$2"),
        *forms(r"^(\d+)\s*ف\((\d+)\)$", "$1 ف ($2)", "$1 ف $2", "$1/ف($2)"),
    ]
    standard = F.transform(F.array(*listed), lambda x: normalize_article(x))
    return F.array_distinct(F.filter(standard, lambda x: x.isNotNull()))


def valid_article(text: Column) -> Column:
    """Whether a number has one of the forms that laws use."""
    letters = "أبجدھهوزحطيكلمنسعفصقرشتثخذضظغ"
    return text.rlike(rf"^\d+(?:\s+(?:{BIS}(?:\s*\([^)]+\))?|\([^)]+\)|[{letters}]))?(?:\s+\d+)?$")
