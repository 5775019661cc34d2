"""Column functions for Arabic text: digits, letters, tokens, stable ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ARABIC, _EASTERN, _WESTERN = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"


def western_digits(text: Column, eastern: bool = False) -> Column:
    """Arabic-Indic digits, and Eastern ones if asked, as Western digits."""
    return F.translate(text, _ARABIC + (_EASTERN if eastern else ""), _WESTERN * (2 if eastern else 1))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_for_topics(text: Column) -> Column:
    """Without vowel marks and tatweel, letters with variants unified, spaces collapsed."""
    bare = F.regexp_replace(text, r"[\u0617-\u061a\u064b-\u0652\u0670\u0640]", "")
    return collapse(F.translate(bare, "أإآىئةؤ", "اااييهو"))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_for_search(text: Column) -> Column:
    """Without vowel marks, composed, spaces collapsed."""
    return collapse(nfc(F.regexp_replace(text, r"[\u0610-\u061a\u064b-\u065f]", "")))


def clean_text(text: Column) -> Column:
    """Compatibility composition without direction marks, no-break spaces as spaces, spaces collapsed within lines."""
    plain = F.regexp_replace(nfkc(text), r"[\u200e\u200f\u202a-\u202e\u2066-\u2069]", "")
    return F.trim(F.regexp_replace(F.translate(plain, "\u00a0", " "), r"[ \t]+", " "))


def tokens(text: Column) -> Column:
    """Words: runs of letters, digits and underscores of any script; case is kept."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")


def split_tokens(texts: pa.Array) -> pa.ListArray:
    """The words of tokens, of Arrow strings inside a task; empty ones may be among them, null texts have null."""
    return pc.split_pattern_regex(texts, r"[^\pL\pN_]+")


def stable_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts joined by bars; a null part reads None."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)
