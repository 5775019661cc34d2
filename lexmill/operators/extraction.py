"""Facts of laws by patterns: penalties, definitions, references, topics, amendments, schedules, rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.arabic import normalize_for_topics, stable_id, western_digits
from lexmill.functions.articles import article_token
from lexmill.functions.reading import PENALTY_MARKS, REFERENCE_MARKS, read_amendment, read_definitions, read_penalties, read_references
from lexmill.functions.vocabulary import CRIME_WORDS, DEFINING_WORDS, PENALTY_TYPES, PENALTY_WORDS, TOPIC_CONFIDENCE, TOPICS

from .chunking import amendment_law, amendment_type, extract
from .dedup import first_wins
from .search import contained


#: Patterns that name no word of the text are tried on every article, so many in one pass.
PATTERN_BLOCK = 200


def required_literals(pattern: str) -> list[str] | None:
    """Strings of which a text that the pattern matches holds at least one; None if there are none to tell.

    Each alternative at the top gives its longest run of plain characters. Groups, classes, and characters that may be
    missing give nothing; with flags other than U, or backreferences to quoting, nothing is told.
    """
    flags = pattern[2 : pattern.index(")")] if pattern.startswith("(?") and ")" in pattern and pattern[2:3].isalpha() else ""
    if set(flags) - {"U"} or "(?" in pattern[len(flags) + 3 if flags else 0 :] or "\\Q" in pattern:
        return None
    pattern = pattern[len(flags) + 3 :] if flags else pattern
    best, runs, run, depth, i = [], [""], "", 0, 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "\\":
            c, i = (pattern[i : i + 1] or " "), i + 1
            plain = not c.isalnum()
        elif c == "[":
            i = pattern.find("]", i + 1 + (pattern[i : i + 1] == "^")) + 1 or len(pattern)
            plain = False
        else:
            plain = c not in "(){}*+?.^$|"
        if depth == 0 and plain:
            run += c
            continue
        if c in "*?{" and not plain and depth == 0:
            run = run[:-1]
        runs.append(run)
        run = ""
        if c == "{" and not plain:
            i = pattern.find("}", i) + 1 or len(pattern)
        depth += (c == "(" and not plain) - (c == ")" and not plain)
        if c == "|" and not plain and depth == 0:
            best, runs = [*best, max(runs, key=len)], [""]
    best.append(max([*runs, run], key=len))
    return best if all(best) else None


def whole_number(text: Column) -> Column:
    return F.regexp_replace(western_digits(text), ",", "").try_cast("bigint")


def with_any(articles: DataFrame, marks: Sequence[str]) -> DataFrame:
    """The articles whose text holds one of these, so that the others never go to a reader."""
    return articles.filter(reduce(Column.__or__, [F.contains("text", F.lit(m)) for m in marks]))


def penalties(articles: DataFrame) -> DataFrame:
    """(law_id, article_number, penalty_type, min_value, max_value, unit) of articles (law_id, article_number, text)."""
    return with_any(articles, PENALTY_MARKS).select("law_id", "article_number", F.explode(read_penalties(F.col("text"))).alias("p")).select("law_id", "article_number", "p.*")


def definitions(articles: DataFrame) -> DataFrame:
    """(law_id, term, definition_text, defined_in_article): each law's first definition of a term, over several lines
    if it goes on there."""
    each = with_any(articles, DEFINING_WORDS).select("law_id", F.col("article_number").alias("defined_in_article"), F.posexplode(read_definitions(F.col("text"))).alias("pos", "d"))
    rows = each.select("law_id", "d.term", "d.definition_text", "defined_in_article", "pos")
    return first_wins(rows, ["law_id", "term"], ["defined_in_article", "pos"]).drop("pos")


def references(articles: DataFrame) -> DataFrame:
    """(law_id, from_article, to_article, reference_type): distinct mentions of other articles."""
    each = with_any(articles, REFERENCE_MARKS).select("law_id", F.col("article_number").alias("from_article"), F.explode(read_references(F.col("text"))).alias("to_article"))
    rows = each.withColumn("to_article", article_token(F.col("to_article"))).filter("to_article <> from_article")
    return rows.distinct().withColumn("reference_type", F.lit("mentions"))


def topic(text: Column) -> Column:
    """The first topic whose words the text holds."""

    def first(bare: Column) -> Column:
        chain = F
        for name, words in TOPICS:
            chain = chain.when(reduce(Column.__or__, [F.contains(bare, normalize_for_topics(F.lit(word))) for word in words]), name)
        return chain

    # the bare text is bound once, as the only element of an array, else each word would make it again
    return F.get(F.transform(F.array(normalize_for_topics(text)), first), F.lit(0))


def topics(articles: DataFrame) -> DataFrame:
    """(law_id, article_number, topic_name, confidence)."""
    rows = articles.select("law_id", "article_number", topic(F.col("text")).alias("topic_name"))
    return rows.filter("topic_name IS NOT NULL").withColumn("confidence", F.lit(TOPIC_CONFIDENCE))


def topics_by_patterns(articles: DataFrame, patterns: DataFrame) -> DataFrame:
    """(law_id, article_number, topic_name): all topics of which an article (law_id, article_number, text) matches a
    pattern; patterns (topic_name, pattern) is a table of the user's with any number of rows.

    A pattern's required words lead to the articles that hold one of them, and it is tried on those alone. Patterns
    without any are tried on every article, PATTERN_BLOCK of them in a pass. So are no more than PATTERN_BLOCK patterns
    in all, each where the article holds one of its words; then no texts are joined. Null texts match nothing.
    """

    @F.pandas_udf("array<string>")
    def literals(values: pd.Series) -> pd.Series:
        return values.map(lambda p: None if p is None else required_literals(p))

    given = patterns.filter("pattern IS NOT NULL").select("topic_name", "pattern").distinct().withColumn("literals", literals("pattern"))
    rows = articles.select("law_id", "article_number", "text", F.xxhash64("law_id", "article_number", "text").alias("__key"))
    texts = rows.filter("text IS NOT NULL").select("__key", "text").distinct()
    few = given.limit(PATTERN_BLOCK + 1).collect()
    if len(few) <= PATTERN_BLOCK:
        held = lambda r: reduce(Column.__or__, [F.contains("text", F.lit(x)) for x in r.literals]) if r.literals else F.lit(True)
        if not few:
            return articles.select("law_id", "article_number", F.lit(None).cast("string").alias("topic_name")).limit(0)
        tried = [F.when(held(r) & F.col("text").rlike(r.pattern), F.struct(F.lit(r.topic_name).cast(given.schema["topic_name"].dataType).alias("topic_name"))) for r in few]
        hits = F.filter(F.array(*tried), lambda x: x.isNotNull())
        return articles.select("law_id", "article_number", F.inline(hits)).distinct()
    named = given.filter("literals IS NOT NULL").select("topic_name", "pattern", F.explode("literals").alias("literal"))
    may = contained(texts, named, "__key", "text", "literal").select("__key", "topic_name", "pattern").distinct()
    hits = may.join(texts, "__key").filter(F.rlike("text", F.col("pattern"))).select("__key", "topic_name")
    wide = [r for r in given.filter("literals IS NULL").select("topic_name", "pattern").toLocalIterator()]
    for i in range(0, len(wide), PATTERN_BLOCK):
        tried = F.array(*[F.when(F.col("text").rlike(r.pattern), F.lit(r.topic_name)) for r in wide[i : i + PATTERN_BLOCK]])
        hits = hits.unionByName(texts.select("__key", F.explode(F.filter(tried, lambda x: x.isNotNull())).alias("topic_name")))
    return rows.join(hits.distinct(), "__key").select("law_id", "article_number", "topic_name").distinct()


def amendments(files: DataFrame) -> DataFrame:
    """Amending laws of files (law_id, name, text): number, date, type, the articles they touch, a description.

    Files without a number and year, or without any article, are left out.
    """
    text, found = F.col("text"), F.col("__read")
    # as a generated row what was read passes the filter below, which else would read again
    read = files.select("*", F.explode(F.array(read_amendment(text))).alias("__read"))
    number, year = amendment_law(F.col("name"), text, found["pairs"])
    touched = F.array_distinct(F.transform(found["touched"], article_token))
    rows = read.select("law_id", text, "__read", number.alias("amendment_law_number"), year.alias("year"), touched.alias("amended_article_numbers"))
    rows = rows.filter((F.col("amendment_law_number").isNotNull()) & F.col("year").isNotNull() & (F.size("amended_article_numbers") > 0))
    described = F.substring(F.trim(F.coalesce(found["first"], text)), 1, 500)
    date = F.coalesce(found["day"], F.concat("year", F.lit("-01-01")))
    return rows.select(
        stable_id(F.col("law_id"), F.col("amendment_law_number"), F.col("year")).alias("amendment_id"),
        "law_id",
        "amendment_law_number",
        F.format_string("قانون رقم %s لسنة %s", "amendment_law_number", "year").alias("amendment_law_title"),
        date.alias("amendment_date"),
        amendment_type(text).alias("amendment_type"),
        "amended_article_numbers",
        described.alias("description"),
        date.alias("effective_date"),
    )


def schedule_entries(tables: DataFrame) -> DataFrame:
    """(law_id, table_number, entry_number, name, latin_name) of numbered lines of tables (law_id, table_number, text)."""
    lines = tables.select("law_id", "table_number", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    head = r"(?U)^([0-9٠-٩]+)\s*[-–.)]\s*(.+)$"
    name = F.trim(F.regexp_replace(extract(line, head, 2), "[A-Za-z(].*$", ""))
    rows = lines.filter(line.rlike(head)).select("law_id", "table_number", whole_number(extract(line, head, 1)).cast("int").alias("entry_number"), name.alias("name"), extract(line, r"([A-Za-z][A-Za-z0-9 ,'-]*)").alias("latin_name"))
    return rows


def classified_rules(chunks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row for each chunk (law_id, text) and kind of rule whose pattern it matches, distinct by its first 200 characters."""
    kinds = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    rows = chunks.select("law_id", "text", F.explode(kinds).alias("rule_type")).withColumn("key", F.substring(normalize_for_topics(F.col("text")), 1, 200))
    return first_wins(rows, ["law_id", "rule_type", "key"], ["text"]).drop("key")


def sentence_rules(articles: DataFrame) -> DataFrame:
    """(article_id, rule_id, rule_text, concepts, penalty) of the sentences of articles (article_id, text) that name a
    crime or a penalty; of an article without any its first 2000 characters, as one rule without concepts.

    penalty is (type, min_value, max_value, notes): the first type by its words, a length of time as both values, the
    sentence as notes if it has a type.
    """
    text = F.col("text")
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.؟!\n])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    has_any = lambda s, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))
    found = F.filter(sentences, lambda s: has_any(s, CRIME_WORDS + PENALTY_WORDS))
    each = articles.select("article_id", (F.size(found) > 0).alias("__any"), F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(F.trim(text), 1, 2000)))).alias("pos", "rule_text"))
    rule = F.col("rule_text")
    kind = F.lit(None).cast("string")
    for name, words in reversed(PENALTY_TYPES):
        kind = F.when(has_any(rule, words), name).otherwise(kind)
    kind = F.when(F.col("__any"), kind)
    value = F.when(F.col("__any"), whole_number(extract(rule, r"([0-9٠-٩]+)\s*(?:سنوات|سنة|شهر|أشهر|يوم|أيام)")))
    concepts = F.filter(F.array(*map(F.lit, CRIME_WORDS)), lambda w: F.col("__any") & F.contains(rule, w))
    penalty = F.struct(kind.alias("type"), value.alias("min_value"), value.alias("max_value"), F.when(kind.isNotNull(), rule).otherwise("").alias("notes"))
    return each.select("article_id", stable_id(F.col("article_id"), F.col("pos")).alias("rule_id"), "rule_text", concepts.alias("concepts"), penalty.alias("penalty"))


def keyword_entities(frame: DataFrame, keywords: dict[str, list[str]], text: str = "text") -> DataFrame:
    """frame with a column for each kind of keyword: those that the text holds."""
    return frame.select("*", *[F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(text), w)).alias(kind) for kind, words in keywords.items()])


def summary(articles: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(law_id, articles, <name> of each table of facts): counts for each law, 0 where a law has none."""
    out = articles.groupBy("law_id").agg(F.count(F.lit(1)).alias("articles"))
    for name, frame in facts.items():
        out = out.join(frame.groupBy("law_id").agg(F.count(F.lit(1)).alias(name)), "law_id", "left").na.fill(0, [name])
    return out


def order_in_law(tables: DataFrame) -> DataFrame:
    """tables with position: the place in its law by table number as text, then pos."""
    return tables.withColumn("position", F.row_number().over(Window.partitionBy("law_id").orderBy("table_number", "pos")) - 1)
