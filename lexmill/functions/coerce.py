"""Column functions that read loosely typed fields of extracted entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arabic import western_digits
from .vocabulary import AUDIT_FALSE_WORDS, AUDIT_TRUE_WORDS, ENUM_DEFAULTS, FALSE_WORDS, LAW_ALIASES, LAWS, ROUTES, TRUE_WORDS


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def bool_required(text: Column) -> Column:
    """True for a word of agreement, otherwise false."""
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_WORDS), F.lit(False))


def bool_optional(text: Column) -> Column:
    """True or false for a word of agreement or denial, otherwise null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def bool_of_audit(text: Column) -> Column:
    """True or false for a word that auditors use, whose lists are shorter and have one word more, otherwise null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(AUDIT_TRUE_WORDS), True).when(word.isin(AUDIT_FALSE_WORDS), False)


def alibi(json: Column) -> Column:
    """An alibi as text: of an object its time, place and witnesses joined by dashes, otherwise the text itself."""
    witnesses = F.nullif(F.array_join(F.from_json(F.get_json_object(json, "$.supporting_witnesses"), "array<string>"), "، "), F.lit(""))
    parts = F.concat_ws(" — ", _field(json, "time"), _field(json, "location"), F.concat(F.lit("شهود: "), witnesses))
    return F.nullif(F.when(F.trim(json).startswith("{"), parts).otherwise(F.trim(json)), F.lit(""))


def age(text: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(western_digits(text, eastern=True), r"(\d+)", 1).try_cast("int")


def with_default(text: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(default))


def enum_value(text: Column, field: str, members: list[str]) -> Column:
    """The member that the text names in any case, or the field's default."""
    word = F.upper(F.trim(text)) if ENUM_DEFAULTS[field].isupper() else F.lower(F.trim(text))
    return F.when(word.isin(members), word).otherwise(ENUM_DEFAULTS[field])


def law_code(text: Column) -> Column:
    """A law's id from its id, or from the first known title that the text holds."""
    known = [law for law, *_ in LAWS]
    names = [(title, law) for law, _, title, _ in LAWS] + list(LAW_ALIASES.items())
    chain = F.when(F.trim(text).isin(known), F.trim(text))
    for name, law in sorted(names, key=lambda x: -len(x[0])):
        chain = chain.when(text.contains(name), law)
    return chain


def route(stem: Column) -> Column:
    """The document type of a file by words in its name; the first type in order of priority, or null."""
    name = F.translate(F.lower(stem), "- ", "__")
    chain = None
    for kind, words in ROUTES:
        hit = reduce(lambda x, y: x | y, [name.contains(w) for w in dict.fromkeys([kind, *words])])
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def date_or_range(json: Column) -> Column:
    """A date as text; an object with start and end as both, joined by the Arabic word for "to"."""
    ends = [blank_to_null(F.get_json_object(json, f"$.{x}")) for x in ("start", "end")]
    return F.when(F.trim(json).startswith("{"), F.nullif(F.concat_ws(" إلى ", *ends), F.lit(""))).otherwise(blank_to_null(json))


def placeholder_to_null(text: Column) -> Column:
    """Null for blank texts and those of dashes, underscores and dots alone."""
    return F.when(~text.rlike(r"^[\s\-_.]*$"), F.trim(text))


def string_list(json: Column) -> Column:
    """The strings of a JSON array, of its objects the first string; a bare string is an array of one, null of none."""
    variant = F.try_parse_json(json)
    items = F.try_variant_get(variant, "$", "array<variant>")
    one = F.transform(
        items,
        lambda v: F.coalesce(
            F.when(F.schema_of_variant(v) == "STRING", v.cast("string")),
            F.get(F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,string>")), lambda s: F.trim(s) != ""), F.lit(0)),
        ),
    )
    found = F.filter(F.transform(one, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    bare = F.when(F.schema_of_variant(variant) == "STRING", F.array(F.try_variant_get(variant, "$", "string")))
    loose = F.when(variant.isNull() & (F.trim(json) != ""), F.array(json))
    return F.coalesce(found, bare, loose, F.array().cast("array<string>"))


def strip_fences(text: Column) -> Column:
    """Text without the marks of a fenced block around it."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))


def salvage_json(text: Column) -> Column:
    """The JSON in a model's answer: without fences, unquoted if quoted twice, or cut from the first to the last brace."""
    bare = strip_fences(text)
    unquoted = F.try_variant_get(F.try_parse_json(bare), "$", "string")
    cut = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    object_of = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).rlike(r"^[\[{]"), c)
    return F.coalesce(object_of(bare), object_of(unquoted), object_of(cut))


def retry_after(error: Column) -> Column:
    """Seconds that an error message asks to wait."""
    return F.regexp_extract(error, r"(?i)retry[- ]after\D{0,5}(\d+(?:\.\d+)?)", 1).try_cast("double")


def _field(json: Column, *names: str) -> Column:
    return F.coalesce(*[blank_to_null(F.get_json_object(json, f"$['{n}']")) for n in names])


def name_with_title(json: Column) -> Column:
    """A person's name: of an object name and title joined by a dash, of an array its strings joined by Arabic commas."""
    parts = F.concat_ws(" - ", _field(json, "name", "الاسم"), _field(json, "title", "الصفة", "role", "صفة"))
    listed = F.array_join(string_list(json), "، ")
    chosen = F.when(F.trim(json).startswith("{"), parts).when(F.trim(json).startswith("["), listed).otherwise(F.trim(json))
    return F.nullif(chosen, F.lit(""))


def factor(json: Column) -> Column:
    """A factor of a sentence as text: an object's factor, else its description, else the value itself."""
    return F.when(F.trim(json).startswith("{"), F.coalesce(_field(json, "factor", "description"), json)).otherwise(blank_to_null(json))


def statement_summary(json: Column) -> Column:
    """A statement as text: questions and answers of an array of objects line by line, other values as they are."""
    pairs = F.from_json(json, "array<struct<question string, answer string>>")
    lines = F.transform(pairs, lambda p: F.concat_ws("\n", F.concat(F.lit("س: "), p["question"]), F.concat(F.lit("ج: "), p["answer"])))
    return F.when(F.trim(json).startswith("["), F.nullif(F.array_join(lines, "\n"), F.lit(""))).otherwise(blank_to_null(json))
